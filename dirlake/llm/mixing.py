"""Mixing sources to target weights by weighted fair queueing.

The shuffled documents of a source queue in packets of a bounded number of words, pass after pass. A packet's virtual finish time is
the source's words up to its end divided by the source's target; all packets are range-sorted by that time and cut at the total budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import packed, pieces, running_sums, utf8, work_table
from dirlake.llm.textstats import count_words

#: Weights of the sources in the order of their names, the most passes over a source, and the words of a packet.
WEIGHTS, PASSES, QUANTUM = (5, 2, 1), 3, 1024
#: Virtual times that may bound the queue.
_HORIZONS = (1.0001, 1.001, 1.01, 1.05, 1.2, 1.5, 2.0, 4.0, 16.0, 256.0, 65536.0)


def size_of(text: Column) -> Column:
    """Words of each whole text; 0 for a null."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *(count_words(*utf8(p)) for p in pieces(texts))]))

    return count(text.cast("string"))


def shuffle_key(doc_id: Column, seed: int = 1) -> Column:
    """The place of a document in its source's queue: a fixed pseudo-random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, target) for unique rows (source, source_size).

    The targets share the sum of all sizes by weight. A target stops at `passes` times its source's size; what is
    above is shared again by weight among the rest until none is above. Each round is one small aggregate.
    """
    named = sources.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_all", F.lit(0).cast("bigint")).withColumn("_null", F.col("source").isNull())
    ranked = work_table(running_sums(named, "_all", ["_null", "source"], ["_one"], 8).select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("_one_before") % len(weights) + 1).cast("int")).cast("double").alias("weight")))
    cap = passes * F.col("source_size").cast("double")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, capped = total[0] / max(total[1], 1), 0
    while True:
        over = cap < level * F.col("weight")
        held, left, n = ranked.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if n == capped or not left:
            break
        level, capped = (total[0] - held) / left, n
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def horizon(aims: DataFrame, passes: int, quantum: int) -> float:
    """A virtual time by which the packets that have finished fill the budget for certain; infinite where none of the tried times proves it."""
    size, target = F.col("source_size").cast("double"), F.col("target")
    # packets that end by v hold all of a source's passes or all but one packet of its target times v
    surplus = [F.sum(F.least(passes * size, F.greatest(F.lit(0.0), target * v - quantum)) - target) for v in _HORIZONS]
    got = aims.where(target > 0).agg(*surplus).first()
    return next((v for v, s in zip(_HORIZONS, got, strict=True) if s is not None and s >= 1), float("inf"))


def packets(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, passes: int = PASSES, quantum: int = QUANTUM, seed: int = 1, tag: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(sized, served): work tables of the rows of `docs` and of the passes that the mix takes of them.

    `sized` has (row, doc_id, source, key, hash, size, source_size, target, size_before) and the columns `tag` of `docs`; `served`
    has (row, pass, taken, finish), taken > 0: what the budget's cut of the queue leaves of a document's words in a pass, and when its last packet is served.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), shuffle_key(F.col(doc_id), seed).alias("key"), F.xxhash64(F.col(text)).alias("hash"), size_of(F.col(text)).alias("size"), *tag)
    sized = work_table(rows.withColumn("row", F.monotonically_increasing_id()))
    aims = work_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes))
    # the queue's name: a null source and an empty one differ
    named = sized.withColumn("queue", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))
    placed = running_sums(named, "queue", ["key", "size", "hash", "row"], ["size"])
    sized = work_table(placed.join(aims.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "queue"))
    reach = horizon(aims, passes, quantum)
    each = sized.where("size > 0 and target > 0").select("row", "key", "size", "target", "size_before", "source_size", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    begun = each.withColumn("base", F.col("size_before") + F.col("pass") * F.col("source_size")).where(F.col("base") / F.col("target") <= reach)
    cut = begun.select("row", "key", "pass", "size", "target", "base", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / quantum))).alias("k"))
    end = F.least(F.col("size"), (F.col("k") + 1) * quantum)
    queue = cut.select("row", "pass", "key", (end - F.col("k") * quantum).alias("words"), ((F.col("base") + end) / F.col("target")).alias("finish")).where(F.col("finish") <= reach)
    budget = aims.agg(F.round(F.sum("target")).cast("bigint")).first()[0] or 0
    served = running_sums(queue.withColumn("all", F.lit(0).cast("bigint")), "all", ["finish", "key", "row", "pass"], ["words"])
    got = served.select("row", "pass", "finish", F.least(F.col("words"), F.lit(budget) - F.col("words_before")).alias("taken")).where("taken > 0")
    return sized, work_table(got.groupBy("row", "pass").agg(F.sum("taken").alias("taken"), F.max("finish").alias("finish")))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """One row for each row of `docs`: doc_id, source, key, size, source_size, target, taken, finish.

    A source's documents queue in a shuffled order, `passes` times over; `taken` are a document's words among the packets before the
    cut, over all passes, and `finish` the virtual time at which the last of them is served (null: none is). So each source's words
    come within a packet of its target. A null or empty text has no words and none taken. A null source is a source of its own, the last one.

    Repeated rows queue one by one; rows of one id, and those with null ids, stand in the order of their sizes, then of a hash of their texts. Only
    rows of equal id and text are told apart by their place, so reruns agree. Packets that finish at one time are served by key.
    """
    sized, served = packets(docs, **options)
    each = served.groupBy("row").agg(F.sum("taken").alias("taken"), F.max("finish").alias("finish"))
    return sized.join(each, "row", "left").select("doc_id", "source", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "finish")


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """Whole rows of `docs` in the order of the mix, a row for each pass that takes it; a pass that takes a part counts from one half on.

    A row is known by a 128-bit hash of all its columns, so rows that are equal in every column stand for each other, and nothing else
    does. `docs` is read twice and has to give the same rows again. Columns that Spark cannot hash (maps) are an error.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    flags = [c.isNull() for c in columns]
    # of the type that the stored keys have: else a join casts it, and shuffles whole rows once more
    key = F.struct(F.xxhash64(*columns, *flags).alias("col1"), F.xxhash64(F.lit(7), *reversed(columns), *flags).alias("col2")).cast("struct<col1: bigint, col2: bigint>")
    known = docs.select(key.alias("id"), packed(docs).alias("own"))
    sized, served = packets(known.select("id", F.col("own")[text].alias("text"), F.col("own")[source].alias("source"), F.col("own")[doc_id].alias("doc_id")), tag=["id"], **options)
    whole = served.join(sized.select("row", "id", "size"), "row").where("2 * taken >= size")
    # the narrow queue is dealt by time first: a row that many ids share has a bounded number of times in each deal, and its columns go there once
    dealt = whole.select("id", "finish").repartitionByRange("finish").withColumn("deal", F.spark_partition_id())
    times = dealt.groupBy("id", "deal").agg(F.collect_list("finish").alias("times"))
    one = known.groupBy("id").agg(F.first("own").alias("own"))
    placed = one.join(times, "id").select("deal", "own", F.col("id").getItem("col1").alias("tie"), "times").repartitionByRange("deal")
    return placed.select("own", "tie", F.explode("times").alias("finish")).sortWithinPartitions("finish", "tie").select("own.*")
