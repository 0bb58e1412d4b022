"""Document fingerprints: the k smallest hashes of a text's word shingles. All of it is column expressions.

Hashes of different shingles behave like uniform draws, so the k smallest of a set are a uniform sample of it that any other set can be
compared with: sketches of parts merge into the sketch of the whole, and the kth smallest hash tells how many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes that a sketch keeps, words of a shingle, and what separates words.
K, WIDTH, SPACE = 256, 5, r"[\x20\x09-\x0D]+"
#: Rows of a block of neighbours, and the most blocks: a list of that many bounds goes to every task (16 bytes each).
BLOCK, MOST_BLOCKS = 1024, 1 << 14


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once: what stands inside another lambda would be computed for each of its elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of all windows of `width` words of the whole text; fewer words are one shingle, no words (or null) none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - (width - 1), F.least(F.size(w), F.lit(1)))
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, width)))

    return F.array_distinct(_let(words, hashes))


def lowest(hashes: Column, k: int = K) -> Column:
    """The k smallest of an array of distinct hashes, ascending."""
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text: its `k` smallest shingle hashes, ascending; all, if there are fewer. Equal texts have equal sketches."""
    return lowest(shingle_hashes(text, width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return lowest(F.array_union(a, b), k)


def merge_rows(df: DataFrame, sketches: str, keys: list[str], k: int = K) -> DataFrame:
    """(keys, sketch): the sketches of all rows of a key as one, such as of the parts of a book or of all documents of a source.

    Each task keeps the `k` smallest hashes of a key before anything is shuffled, so a key may hold any share of the rows. Null
    sketches add nothing; keys that are null are one key; a key without any hash keeps an empty sketch.
    """
    names = [f"key{i}" for i in range(len(keys))]
    each = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)), F.explode_outer(sketches).alias("h")).distinct()
    placed = each.withColumn("at", F.row_number().over(Window.partitionBy(*names).orderBy(F.col("h").asc_nulls_last()))).where(F.col("at") <= k)
    out = placed.groupBy(*names).agg(F.sort_array(F.collect_list("h")).alias("sketch"))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), "sketch")


def distinct_shingles(s: Column, k: int = K) -> Column:
    """How many different shingles a sketch stands for: exact below `k`, else k - 1 over the share of the hash range below its largest hash."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of two texts' shingles that both have (Jaccard): of the sketch of both together, the part that is in each. Two texts without shingles are alike.

    Exact where both have `k` shingles together at most; else its standard error is below 0.5 / sqrt(k).
    """
    return _let(merge(a, b, k), lambda both: F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has too; 1 where a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def printed(s: Column) -> Column:
    """A sketch as text, 16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def parsed(fingerprint: Column) -> Column:
    """The sketch that `printed` wrote."""
    size = (F.length(fingerprint) / 16).cast("int")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    half = lambda at: F.conv(F.substr(fingerprint, at, F.lit(8)), 16, 10).cast("bigint")
    return F.transform(starts, lambda i: F.shiftleft(half(i * 16 + 1), 32).bitwiseOR(half(i * 16 + 9)))


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Every row of `docs` with `sketch`, its `fingerprint` as text and `n_shingles`, the estimate of its different shingles.

    Columns of `docs` with these names are replaced. Null and blank texts have an empty sketch and 0 shingles; rows that repeat stay as they are; an empty table gives none.
    """
    out = docs.withColumn("sketch", sketch(F.col(f"`{text}`"), k, width))
    return out.withColumn("fingerprint", printed(F.col("sketch"))).withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def with_next(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document and the next one by descending doc_id; after the last comes the first.

    Null ids stand last; rows of equal ids stand by the hash of their text; a null text is empty; a single row is its own next. The
    narrow keys are range-sorted once, and each range's greatest key bounds a block. Documents go to their blocks in one shuffle, the
    first of each block to the block before it as well, so that every row finds its next one without a global window.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", key)
    n = rows.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // block)))
    ranged = rows.select("key").repartitionByRange(blocks, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key"))
    bounds = ranged.agg(F.sort_array(F.collect_list("key")).alias("bounds"))
    placed = rows.withColumn("bounds", bounds.scalar()).withColumn("b", F.least(_below(F.col("bounds"), F.col("key")), F.size("bounds") - 1))
    ends = F.get("bounds", F.col("b")) == F.col("key")
    own = F.struct(F.col("b"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("b") + 1, F.size("bounds")).alias("b"), F.lit(True).alias("ahead"))
    sent = placed.select("doc_id", "text", "key", F.explode(F.when(ends, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    # shuffled before they are sketched, so that sketches stay where they are made
    sent = sent.select("doc_id", "text", "key", "to.b", "to.ahead").repartition("b").withColumn("sketch", sketch(F.col("text")))
    at = Window.partitionBy("b").orderBy("ahead", F.col("key").desc())
    found = sent.withColumn("next", F.lead(F.struct("text", "sketch")).over(at)).where("not ahead")
    return found.select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def _below(bounds: Column, key: Column) -> Column:
    """How many of the ascending bounds are smaller than the key: first among every 128th, then among the 128 that follow."""
    step = 128
    coarse = F.transform(F.sequence(F.lit(0), F.floor((F.size(bounds) - 1) / step).cast("int")), lambda i: F.get(bounds, i * step))
    at = F.greatest(F.size(F.filter(coarse, lambda x: x < key)) - 1, F.lit(0)) * step
    return at + F.size(F.filter(F.slice(bounds, at + 1, step), lambda x: x < key))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (code points, rounded down) replaced by as many of the beginning of the following text."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(following, F.lit(1), cut))
