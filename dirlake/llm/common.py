"""Shared pieces of the corpus operators: work tables, splits and a distributed scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.storage import shared_dir

#: The white space that ends a word, as a Java/RE2 character class body.
WORD = r"[^\x20\x09-\x0D]+"


_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Work tables written inside go at the end, but for those that are kept: what leaves the block is one of these."""
    paths: list[tuple[SparkSession, str]] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()
        for spark, path in paths:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def work_table(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: a lineage cut that outlives executors.

    The files go at the end of the surrounding `scratch` block (with `keep`, of the one around that), or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append((spark, path))
    else:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The named columns of `df` (all where None) as one struct, so that no column of an operator's own can clash with them."""
    names = df.columns if columns is None else columns
    return F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(None).cast("boolean").alias("none"))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and its n + 1 offsets; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def pieces(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of about `most_bytes` of text; one longer text is a slice of its own."""
    if len(texts) == 0:
        return
    _, ends = utf8(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most_bytes, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def skew_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], n: str, most: int = 4096) -> DataFrame:
    """The inner join of `rows` with `side` on `keys`, where a few keys may hold most rows.

    `side` is a stored table with one row for each key and tells in `n` how many of `rows` have it. Keys with more than 1 / `most` of
    all those rows are fewer than `most`, so their rows of `side` go to every task and `rows` stay where they are; all others are joined by a shuffle.
    `rows` is read twice and should be stored too.
    """
    total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    bound = F.col(n) > total / most
    hot = F.broadcast(side.where(bound))
    rest = rows.join(F.broadcast(side.where(bound).select(*keys)), list(keys), "left_anti")
    return rows.join(hot, list(keys)).unionByName(rest.join(side.where(~bound), list(keys)))


def running_sums(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], parts: int | None = None, upto: bool = False) -> DataFrame:
    """`df` with `<value>_before` columns: sums of `values` over the rows of the same key that stand earlier in `order`, and with `upto` `<value>_upto` columns, the row's own value included.

    The sums wrap around at 64 bits. `key` is a non-null column. Rows are range-sorted by key and order, so
    that a key of any size spreads over many tasks. The sorted rows are checkpointed, each partition reports one
    sum for its last key (as many rows as partitions), and a second pass adds what earlier partitions hold.
    """
    spark = df.sparkSession
    shared_dir(spark)
    by = [F.col(key), *(F.col(c) for c in order)]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).checkpoint()
    # the sorted rows go with the driver's JVM, whether or not the cluster cleans checkpoints
    jpath = spark._jvm.org.apache.hadoop.fs.Path(placed._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    names = [*values]

    def last_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, sums = None, None, np.zeros(len(names), np.int64)
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(key)
                part, last = batch.column("_part")[0].as_py(), keys[-1].as_py()
                same = np.asarray(pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False), bool)
                own = np.array([_wrapped(batch.column(v), same) for v in names], np.int64)
                with np.errstate(over="ignore"):
                    sums = sums + own if last == current else own
                current = last
        if part is not None:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([current], placed_key), *(pa.array([int(x)], pa.int64()) for x in sums)], names=["part", "last", *names])

    placed_key = pa.string() if dict(placed.dtypes)[key] == "string" else pa.int64()
    key_type = "string" if placed_key == pa.string() else "bigint"
    narrow = placed.select("_part", F.col(key).cast(key_type).alias(key), *names)
    edges = sorted(narrow.mapInArrow(last_key, f"part int, last {key_type}, " + ", ".join(f"`{v}` bigint" for v in names)).collect())
    carried: dict[int, tuple] = {}
    running: tuple = (None, [0] * len(names))
    for part, last, *sums in edges:
        carried[part] = running
        before = running[1] if last == running[0] else [0] * len(names)
        running = (last, [_wrap(a + b) for a, b in zip(before, sums, strict=True)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, np.zeros(len(names), np.int64)
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                current, before = carried[batch.column("_part")[0].as_py()]
                sums, first = np.array(before, np.int64), False
            keys = batch.column(key)
            starts = np.flatnonzero(np.concatenate([[True], _differs(keys)]))
            out = []
            lengths = np.diff(np.append(starts, batch.num_rows))
            for j, v in enumerate(names):
                x = batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                with np.errstate(over="ignore"):
                    c = np.cumsum(x)
                    before = c - x
                    base = -before[starts]
                    if keys[0].as_py() == current:
                        base[0] += sums[j]
                    before += np.repeat(base, lengths)
                    sums[j] = before[-1] + x[-1]
                out.append(pa.array(before, pa.int64()))
                if upto:
                    with np.errstate(over="ignore"):
                        out.append(pa.array(before + x, pa.int64()))
            current = keys[-1].as_py()
            yield pa.record_batch([*batch.columns, *out], names=[*batch.schema.names, *sums_of])

    sums_of = [f"{v}_{what}" for v in names for what in (("before", "upto") if upto else ("before",))]
    return placed.mapInArrow(add, fields + "".join(f", `{v}` bigint" for v in sums_of)).drop("_part")


def _wrap(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _wrapped(column: pa.Array, mask: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(column.to_numpy(zero_copy_only=False).astype(np.int64)[mask].sum(dtype=np.int64))


def _differs(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before it."""
    if len(keys) < 2:
        return np.zeros(0, bool)
    return pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).astype(bool)
