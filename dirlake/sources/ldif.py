"""LDIF as a source and a sink.

Each record is cut into its entry once, by a function over whole Arrow columns; all that follows is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dirlake.functions import records as R
from dirlake.functions import text as T
from dirlake.functions.dn import strip
from dirlake.model import ATTRS, CONTROLS, OPS
from dirlake.sources import ldif_source as source
from dirlake.storage import stored

#: Fixed value: the first line of a file with a version.
VERSION = "version: 1"
_WRITTEN = {"dn": "string", "changetype": "string", "attrs": ATTRS, "newrdn": "string", "newsuperior": "string", "deleteoldrdn": "boolean", "controls": CONTROLS, "change_ops": OPS}


def records(text: Column) -> Column:
    """The unfolded records of an LDIF text: blocks between blank lines, without a leading version line, empty ones left out."""
    blocks = F.split(T.unfold(F.regexp_replace(text, r"\r\n", "\n")), r"\n[ \t]*(?:\n[ \t]*)+")
    plain = F.transform(blocks, lambda b: F.regexp_replace(F.btrim(b, F.lit("\n")), r"(?i)^version:[^\n]*(?:\n+|$)", ""))
    return F.filter(plain, lambda b: strip(b) != "")


def parse(df: DataFrame, record: str = "record") -> DataFrame:
    """`df` with the columns of an entry parsed from one unfolded record each, instead of `record`.

    A later `dn:` line takes the place of an earlier one. A name missing or with a component that is not `type=value` sets
    `error` and leaves the rest as read: bad records are rows, not losses. Inside modify records, values are attributes as well
    as parts of the operation that stands open, whatever name they bear. An unknown change type leaves a content record. A null record is an empty one.

    Values are trimmed, those of change operations that were encoded are not; encoded and linked ones keep their payload in `raw`, with which they are written again.
    """
    others = [c for c in df.columns if c != record]
    name = max(["entry", *others], key=len) + "_"
    cut = df.select(*(F.col(f"`{c}`") for c in others), R.cut(F.coalesce(F.col(record), F.lit(""))).alias(name))
    return cut.select(*(F.col(f"`{c}`") for c in others), f"`{name}`.*")


def parse_text(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with one row for each record of an LDIF text, numbered from 0, parsed, instead of `text`."""
    return parse(df.select(*(c for c in df.columns if c != text), F.posexplode(records(F.coalesce(F.col(text), F.lit("")))).alias("record_no", "record")))


def read_ldif(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", crlf: bool | None = None, number: bool = False) -> DataFrame:
    """The entries of all files of a path, folder or pattern, with `source` and `record_no`, which orders the records of a file.

    The data source of `dirlake.sources.ldif_source` reads each byte once and takes either line end. Stores that it cannot reach, and calls that tell
    `crlf`, are read by Spark's text reader, which splits at the blank lines of that line end (LF, if not told) and has a file with the other one in one task.
    `number` makes `record_no` count from 0 within each file; the entries are stored for that. A path without files raises FileNotFoundError.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if crlf is None and all(map(source.reaches, paths)):
        source.register(spark)
        for p in paths:
            system, inner, _ = source.place(p)
            if not source.files(system, inner):
                raise FileNotFoundError(p)
        parts = [spark.read.format("ldif").option("encoding", encoding).load(p) for p in paths]
        found = reduce(DataFrame.unionByName, parts)
    else:
        try:
            text = spark.read.option("encoding", encoding).text(paths, lineSep="\r\n\r\n" if crlf else "\n\n")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(str(path)) from e
            raise
        each = text.select(F.col("_metadata.file_path").alias("source"), F.explode(records(F.col("value"))).alias("record"))
        found = parse(each.withColumn("record_no", F.monotonically_increasing_id()))
    return numbered(found) if number else found


def sources_of(path: str | list[str], most: int) -> list[str]:
    """The values of `source` that `read_ldif` gives for a path; more than `most` files are an error."""
    out = []
    for p in [path] if isinstance(path, str) else path:
        system, inner, before = source.place(p)
        out += [before + f.path for f in source.files(system, inner)]
    if len(out) > most:
        raise ValueError(f"there are {len(out)} files, more than {most}")
    return out


def numbered(entries: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Entries with `record_no` counted from 0 within each source. Blocks of the ordering numbers are counted, and each record's rank in its block is added to what earlier blocks of its file hold, so that no task ranks a whole file."""
    kept = stored(entries.withColumn("_block", F.floor(F.col("record_no") / block)))
    counts = kept.groupBy("source", "_block").agg(F.count("*").alias("n"))
    # a source has one row for each block here
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_block").orderBy("record_no")) - 1)
    return ranked.join(counts.select("source", "_block", earlier.alias("_earlier")), ["source", "_block"]).withColumn("record_no", F.col("_rank") + F.col("_earlier")).select(*entries.columns)


def read_ldif_stream(spark: SparkSession, path: str, crlf: bool = False) -> DataFrame:
    """New files of a directory as a stream of entries. A file whose line ends are not as `crlf` says is read all the same, but by one task."""
    blocks = spark.readStream.text(path, lineSep="\r\n\r\n" if crlf else "\n\n")
    return parse(blocks.select(F.explode(records(F.col("value"))).alias("record")))


def written(df: DataFrame, width: int = T.WIDTH, column: str = "ldif", comments: bool = False) -> DataFrame:
    """`df` with each entry's LDIF record, without a blank line at its end, in `column`.

    Lines over `width` bytes are folded, access rules never. Encoded and linked values are written with the payload they were read with; other values
    that are not safe text are base64. `comments` writes an entry's comments before its name.
    """
    have = [c for c in _WRITTEN if c in df.columns]
    typed = df.withColumns({c: F.col(c).cast(_WRITTEN[c]) for c in have})
    notes = ["comments"] if comments else []

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = {c: batch.column(c) for c in (*have, *notes)}
            texts = R.texts({c: fields.get(c) for c in (*_WRITTEN, "comments")}, batch.num_rows, width)
            yield pa.record_batch([*batch.columns, texts], names=[*batch.schema.names, column])

    # whole batches, not a function in an expression: what made the attributes stays in a projection of its own
    return typed.mapInArrow(add, StructType([*typed.schema.fields, StructField(column, StringType())]))


def _with_version(texts: DataFrame) -> DataFrame:
    """The version line before the first row of each partition, which becomes a file."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.record_batch([pa.array([VERSION])], names=batch.schema.names)
                first = False
            yield batch

    return texts.mapInArrow(headed, texts.schema)


def write_ldif(df: DataFrame, path: str, width: int = T.WIDTH, mode: str = "errorifexists", order: str | None = None, version: bool = False, comments: bool = False) -> None:
    """Write entries as LDIF files; Spark's commit makes each run all or nothing. `order` sorts over all files by a column's range; `version` opens each file with the version line."""
    out = written(df, width, comments=comments)
    if order:
        out = out.orderBy(order)
    out = out.select("ldif")
    (_with_version(out) if version else out).write.mode(mode).option("lineSep", "\n\n").text(path)


def write_statistics(df: DataFrame, width: int = T.WIDTH) -> DataFrame:
    """One row (entries, lines, bytes, folded): what a written text has, lines that were folded counted once each."""
    text = written(df, width).select("ldif")
    lines = F.size(F.split("ldif", "\n"))
    bent = F.size(F.split("ldif", "\n ")) - 1
    return text.agg(F.count("*").alias("entries"), F.coalesce(F.sum(lines), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.octet_length("ldif") + 2), F.lit(0)).alias("bytes"), F.coalesce(F.sum((bent > 0).cast("bigint")), F.lit(0)).alias("folded"))
