"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

A shingle of weight w is a set of independent Poisson processes on the weight levels [0, 1), [1, 2), [2, 4),
[4, 8) ... that start below w. A process gives points in the order of time; a point has a time, a component of
the signature and a place in its level interval, and counts where that place lies below w. So two texts share a
shingle's points up to the smaller of its two weights, and the first point of each component is the same with
the probability of their weighted Jaccard similarity. Points are made only up to a horizon that a text's total weight
sets; a text with an unfilled component gets a later horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlake.llm.common import packed, pieces, scratch, work_table
from dirlake.llm.graph import components
from dirlake.llm.textstats import Texts, mix, windows

#: A pair with similarity 0.8 shares one of 20 bands of 4 components with probability 0.99997.
BANDS, ROWS = 20, 4
SIZE = BANDS * ROWS
WIDTH = 5
_A, _B, _C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _times(k: int, odd: np.uint64) -> np.uint64:
    return np.uint64(k * int(odd) % (1 << 64))


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each distinct shingle, by text. A text of 1 to 4 words is one shingle."""
    words = t.words()
    h, at = windows(words, t.n_words, WIDTH)
    doc = t.doc[at]
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < WIDTH))
    if len(short):
        h = np.concatenate([h, sequence_hash(t, words)[0][short]])
        doc = np.concatenate([doc, short])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(t.n_words) < 65536 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def sequence_hash(t: Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's sequence of words."""
    start = np.cumsum(t.n_words) - t.n_words
    place = (np.arange(len(words)) - np.repeat(start, t.n_words)).astype(np.uint64)
    out = []
    for salt in (_A, _B):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + mix(place * salt + _C)), out=sums[1:])
        out.append(mix(sums[start + t.n_words] - sums[start] + t.n_words.astype(np.uint64)))
    return out[0], out[1]


def signatures(t: Texts) -> np.ndarray:
    """SIZE components for each text; a row of zeros for a text without words."""
    doc, h, weight = shingles(t)
    n = len(t.n_words)
    total = np.bincount(doc, weight, n)
    sig = np.zeros(n * SIZE, np.uint64)
    best = np.full(n * SIZE, np.inf)
    horizon = SIZE / np.maximum(total, 1) * (np.log(SIZE) + 8)
    todo = total > 0
    while todo.any():
        _first_points(doc, h, weight, np.where(todo, horizon, -1.0), best, sig)
        todo &= np.isinf(best).reshape(n, SIZE).any(1)
        horizon *= 2
    return sig.reshape(n, SIZE)


def _first_points(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, horizon: np.ndarray, best: np.ndarray, sig: np.ndarray) -> None:
    """Put each component's first point up to its text's horizon in `best` and `sig`."""
    own = horizon[doc] > 0
    d, key, w = doc[own], h[own], weight[own]
    low, width, level = 0, 1, 0
    while len(d):
        _run(d, mix(key + _times(level, _A)), w, horizon[d], low, width, best, sig)
        low, width, level = low + width, max(1, low + width), level + 1
        more = w > low
        d, key, w = d[more], key[more], w[more]


def _run(d: np.ndarray, key: np.ndarray, w: np.ndarray, horizon: np.ndarray, low: int, width: int, best: np.ndarray, sig: np.ndarray) -> None:
    """The processes of one level interval, point by point, until all have passed their horizon."""
    time, step = np.zeros(len(d)), 0
    while len(d):
        step += 1
        draw = mix(key + _times(step, _B))
        time = time - np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / width
        live = time <= horizon
        d, key, w, horizon, time, draw = d[live], key[live], w[live], horizon[live], time[live], draw[live]
        slot = d * SIZE + (((draw & np.uint64(0xFFFFFF)) * np.uint64(SIZE)) >> np.uint64(24)).astype(np.int64)
        if low:
            place = low + width * ((mix(draw + _C) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            counts = place < w
        else:
            counts = np.ones(len(d), bool)
        s, x = slot[counts], time[counts]
        np.minimum.at(best, s, x)
        won = best[s] == x
        sig[s[won]] = draw[counts][won]


def _described(texts: pa.Array) -> pa.Array:
    t = Texts.of(texts)
    words = t.words()
    one, two = sequence_hash(t, words)
    sig = signatures(t).reshape(-1, BANDS, ROWS)
    bands = mix(sig[:, :, 0] + _C)
    for r in range(1, ROWS):
        bands = mix(bands * _A + sig[:, :, r])
    return _struct(t, one, two, bands)


def _struct(t: Texts, one: np.ndarray, two: np.ndarray, bands: np.ndarray) -> pa.Array:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
    some = pa.array(t.n_words > 0)
    none = pa.scalar(None, lists.type)
    return pa.StructArray.from_arrays([pa.array(t.n_words.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pc.if_else(some, lists, none)], ["n_words", "one", "two", "bands"])


def describe(text: Column) -> Column:
    """struct<n_words, one, two, bands> of each whole text: 128 bits of its words, and the hashes of its bands (null without words)."""

    @F.arrow_udf("struct<n_words: bigint, one: bigint, two: bigint, bands: array<bigint>>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [_described(p) for p in pieces(texts)]
            yield pa.concat_arrays(done) if done else _described(texts)

    return described(text.cast("string"))


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the weighted Jaccard similarity of each pair of whole texts is 0.8 or more, in whole numbers."""
    n = len(a)
    sides = [shingles(Texts.of(x)) for x in (a, b)]
    total = sum(np.bincount(d, w, n) for d, _, w in sides)
    doc, h, w = (np.concatenate([x[i] for x in sides]) for i in range(3))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h, w = doc[order], h[order], w[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    shared = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), n)
    return (shared > 0) & (5 * shared >= 4 * (total - shared))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b) of `pairs` whose texts overlap enough; `texts` has unique (id, text)."""
    at = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out, lo = [], 0
            for p in pieces(a, 1 << 19):
                out.append(overlaps(p, b.slice(lo, len(p))))
                lo += len(p)
            yield pa.array(np.concatenate([np.zeros(0, bool), *out]))

    return at.where(alike("ta", "tb")).select("a", "b")


def _close(n: str, m: str) -> Column:
    """Whether two word counts allow a similarity of 0.8: texts of n words have max(1, n - 4) shingles."""
    a, b = F.greatest(F.col(n) - (WIDTH - 1), F.lit(1)), F.greatest(F.col(m) - (WIDTH - 1), F.lit(1))
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, kept) for each row of `docs`: the class is the smallest id of all that its links reach.

    Links join texts whose word sequences are equal or whose weighted Jaccard similarity over five-word shingles
    is 0.8 or more. Repeated rows, and ids on several rows, are judged row by row. Null and empty texts link with nothing
    and are classes of their own id. Null ids come last in a class; a class of null ids alone has a null id. Ids may have any type that has an order.

    Texts with equal words are one candidate. In each bucket of a band, all candidates are first compared with the most
    central one, the one whose buckets are fullest; that settles large groups of near copies without pairing them up. Where a bucket then still
    holds several components, its candidates of different components are compared with each other, unless exact bounds rule a link
    out (see _able and _crossing). So the result is that of comparing all pairs of a bucket.
    """
    with scratch():
        rows = _numbered(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), "text")
        placed = _placed(rows, "text", "doc")
        out = rows.where("bands is not null").select(F.col("own.doc").alias("doc"), "one", "two").join(placed.select("one", "two", F.col("first.doc").alias("class_id")), ["one", "two"]).select("doc", "class_id")
        out = out.union(rows.where("bands is null").select(F.col("own.doc").alias("doc"), F.col("own.doc").alias("class_id")))
        return work_table(out.select(F.col("doc").alias(doc_id), "class_id", F.col("doc").eqNullSafe(F.col("class_id")).alias("kept")), keep=True)


def _numbered(docs: DataFrame, text: str, keep: bool = False) -> DataFrame:
    """Work table (row, own, n_words, one, two, bands): each row of `docs` as a struct, its key `row`, and what describes its text."""
    return work_table(docs.select(F.monotonically_increasing_id().alias("row"), packed(docs).alias("own"), describe(F.col(text)).alias("s")).select("row", "own", "s.*"), keep)


def _placed(rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(one, two, comp, first): the component of each word sequence in `rows`, known by its 128 bits, and its first row, struct (none, doc, row): by id, null ids last, then by key.

    Inside, a sequence goes by the key `rep` of one of its rows.
    """
    by = F.struct(F.col("own")[doc_id].isNull().alias("none"), F.col("own")[doc_id].alias("doc"), "row")
    reps = work_table(rows.where("bands is not null").groupBy("one", "two").agg(F.min(by).alias("least"), F.first(F.struct("n_words", "bands")).alias("s")).select("one", "two", F.col("least.row").alias("rep"), "least", "s.*"))
    band = reps.select("rep", "n_words", F.posexplode("bands").alias("band", "value"))
    full = work_table(band.join(band.groupBy("band", "value").agg(F.count("*").alias("members")).where("members > 1"), ["band", "value"]))
    crowd = full.join(full.groupBy("rep").agg(F.sum("members").alias("crowd")), "rep")
    hubs = crowd.groupBy("band", "value").agg(F.max(F.struct("crowd", "rep", "n_words")).alias("hub"))
    near = full.join(hubs, ["band", "value"]).where((F.col("rep") != F.col("hub.rep")) & _close("n_words", "hub.n_words"))
    first = work_table(near.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct())
    texts = _texts(rows, text, full.select("rep", F.col("rep").alias("row")).distinct())
    links = work_table(verified(first, texts))
    found = components(links)
    members = _mixed(full.drop("members"), found)
    able = _able(members, texts)
    # once more a star, around the candidate that shares most, before the others are compared with each other
    most = able.groupBy("band", "value").agg(F.min(F.struct((F.col("total") - F.col("shared")).alias("own"), "rep", "total", "shared")).alias("hub"))
    again = able.join(most, ["band", "value"]).where(_bound("shared", "hub.shared", "total", "hub.total") & (F.col("rep") != F.col("hub.rep"))).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    again = work_table(again.join(first, ["a", "b"], "left_anti"))
    links = work_table(links.union(verified(again, texts)))
    found = components(links)
    able = _able(_mixed(able.drop("comp", "shared", "total"), found), texts)
    rest = _crossing(able, texts)
    tried = first.union(again)
    rest = rest.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti")
    more = work_table(verified(rest, texts))
    final = found if more.isEmpty() else components(links.union(more))
    placed = reps.select("one", "two", "rep", "least").join(final, F.col("rep") == F.col("node"), "left").select("one", "two", "least", F.coalesce("component", "rep").alias("comp"))
    return placed.join(placed.groupBy("comp").agg(F.min("least").alias("first")), "comp").select("one", "two", "comp", "first")


def _bound(shared: str, others: str, total: str, all_others: str) -> Column:
    """Whether what two candidates share with any allows a link, which needs 4/9 of the sum of both."""
    return 9 * F.least(F.col(shared), F.col(others)) >= 4 * (F.col(total) + F.col(all_others))


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (rep, band, value, ...) of buckets with several components, and each candidate's component `comp`."""
    named = rows.join(found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    mixed = named.groupBy("band", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "value")
    return work_table(named.join(mixed, ["band", "value"]))


def _crossing(able: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components in one bucket that may link.

    Let a bucket's hub be its candidate that shares most, and the excess of a text its shingles' weight beyond the hub's. Two texts of
    total weights n and m and excesses e and f that share no excess differ in e + f + |e - f + m - n| at least, and a link differs in a ninth of n + m
    at most. So a link needs either small excesses, or a shared excess shingle. For the second, a text's excess shingles
    are taken from the rarest on up to a weight of n / 5 + 1: two texts that link and pass e or f beyond that agree on one of them.
    """
    most = able.groupBy("band", "value").agg(F.min(F.struct((F.col("total") - F.col("shared")).alias("own"), "rep")).alias("m")).select("band", "value", F.col("m.rep").alias("hub"))
    placed = work_table(able.join(most, ["band", "value"]))
    over = work_table(_excess(placed.select("rep", "hub", "comp", "total", "shared").distinct(), texts))
    sums = over.groupBy("rep", "hub").agg(F.sum("w").alias("excess"))
    near = placed.join(sums, ["rep", "hub"], "left").select("band", "value", "rep", "comp", "total", "shared", F.coalesce("excess", F.lit(0)).alias("excess"))
    x, y = (near.select(*(F.col(c).alias(f"{c}_{k}") for c in near.columns)) for k in "xy")
    differ = F.col("excess_x") + F.col("excess_y") + F.abs(F.col("excess_x") - F.col("excess_y") + F.col("total_y") - F.col("total_x"))
    small = x.join(y, (F.col("band_x") == F.col("band_y")) & (F.col("value_x") == F.col("value_y")) & (F.col("comp_x") < F.col("comp_y")) & _bound("shared_x", "shared_y", "total_x", "total_y") & (9 * differ <= F.col("total_x") + F.col("total_y")))
    seen = over.groupBy("hub", "h").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("hub", "rep").orderBy("n", "h").rowsBetween(Window.unboundedPreceding, -1)
    first = over.join(seen, ["hub", "h"]).withColumn("before", F.coalesce(F.sum("w").over(rare), F.lit(0))).where("before * 5 <= total + 5 and n > 1")
    u, v = (first.select(*(F.col(c).alias(f"{c}_{k}") for c in ("hub", "h", "rep", "comp", "total", "shared"))) for k in "xy")
    common = u.join(v, (F.col("hub_x") == F.col("hub_y")) & (F.col("h_x") == F.col("h_y")) & (F.col("comp_x") < F.col("comp_y")) & _bound("shared_x", "shared_y", "total_x", "total_y"))
    return small.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).union(common.select("rep_x", "rep_y")).distinct()


def _excess(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, hub, comp, total, shared, h, w): the shingles of `rep` beyond those of `hub`, for each row of `pairs`."""
    one, two = texts.select(F.col("id").alias("rep"), F.col("text").alias("ta")), texts.select(F.col("id").alias("hub"), F.col("text").alias("tb"))
    both = pairs.join(one, "rep").join(two, "hub").select("rep", "hub", "comp", "total", "shared", "ta", "tb")
    keep = ["rep", "hub", "comp", "total", "shared"]

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for p in pieces(batch.column("ta"), 1 << 19):
                doc, h, w = shingles(Texts.of(p))
                other, g, v = shingles(Texts.of(batch.column("tb").slice(lo, len(p))))
                d, k, x, own = (np.concatenate(c) for c in ((doc, other), (h, g), (w, v), (np.ones(len(h), bool), np.zeros(len(g), bool))))
                order = np.lexsort((own, k, d))
                d, k, x, own = d[order], k[order], x[order], own[order]
                held = np.concatenate([[0], np.where((d[1:] == d[:-1]) & (k[1:] == k[:-1]), x[:-1], 0)]) if len(d) else x
                at = np.flatnonzero(own & (x > held))
                rows = pa.array(lo + d[at])
                lo += len(p)
                yield pa.record_batch([*(batch.column(c).take(rows) for c in keep), pa.array(k[at].view(np.int64)), pa.array((x - held)[at])], names=[*keep, "h", "w"])

    return both.mapInArrow(beyond, "rep bigint, hub bigint, comp bigint, total bigint, shared bigint, h bigint, w bigint")


def _able(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (rep, comp, ...) of `members` that could link with another component's candidate, with their shingles' weight `total` and what of it is in several components, `shared`."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for p in pieces(batch.column("text")):
                doc, h, w = shingles(Texts.of(p))
                at = pa.array(lo + doc)
                lo += len(p)
                yield pa.record_batch([batch.column("rep").take(at), batch.column("comp").take(at), pa.array(h.view(np.int64)), pa.array(w)], names=["rep", "comp", "h", "w"])

    named = texts.withColumnRenamed("id", "rep").join(members.select("rep", "comp").distinct(), "rep").select("rep", "comp", "text")
    each = work_table(named.mapInArrow(exploded, "rep bigint, comp bigint, h bigint, w bigint"))
    several = each.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    shared = each.join(several, "h").groupBy("rep").agg(F.sum("w").alias("shared"))
    total = each.groupBy("rep").agg(F.sum("w").alias("total"))
    return work_table(members.join(total.join(shared, "rep"), "rep").where("5 * shared >= 4 * total"))


def _texts(rows: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(id, text), one row for each row (rep, row) of `wanted`."""
    return work_table(rows.select("row", F.col("own")[text].cast("string").alias("text")).join(wanted, "row").select(F.col("rep").alias("id"), "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each id that is the smallest of its class, and all rows with a null id. The pipeline judges row by row instead: see keep_rows."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))


def keep_rows(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each class, whatever its rows' ids: the first by id, null ids last. Documents without words all stay."""
    with scratch():
        rows = _numbered(docs, "text", keep=True)
        first = work_table(_placed(rows, "text", "doc_id").select("first.row").distinct(), keep=True)
    return _picked(rows, first, F.col("bands").isNull()).select("own.*")


def _picked(rows: DataFrame, first: DataFrame, always: Column, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of `rows` whose `row` is in the stored table `first`, and those where `always` holds.

    Up to `most_bytes`, `first` goes to every task as bitmaps of 4 KB, each of 32,768 numbers, so that whole rows stay where they are. Beyond that, rows are joined by a shuffle.
    """
    numbered = first.select("row", F.bitmap_bucket_number("row").alias("bucket"))
    if numbered.select("bucket").distinct().count() * 4096 > most_bytes:
        return rows.where(~always).join(first, "row", "left_semi").union(rows.where(always))
    maps = numbered.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
    place = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("bucket", F.bitmap_bucket_number("row")).join(F.broadcast(maps), "bucket", "left")
    return held.where(always | F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).select(*rows.columns)
