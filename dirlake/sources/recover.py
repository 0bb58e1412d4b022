"""LDIF that breaks the rules, read as far as it can be and written again: records without blank lines between them, any line end, lines that nobody can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.functions import text as T
from dirlake.model import ATTRS
from dirlake.sources import ldif

#: What opens the comment of a line that could not be read.
MARK = "unreadable: "


def recovered_records(text: Column) -> Column:
    """The unfolded records of a text: a record begins behind a blank line and at each `dn:`, with the comments right above it, and lines may end with CR, LF or both. Blanks before a `dn:` that follows an empty line, and blank records, go."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    lines = F.regexp_replace(lines, r"(?i)(^|\n)[ \t]*\n[ \t]+(?=dn:)", "$1\n")
    whole = T.unfold(lines)
    # a later `dn:` is set apart, its comments with it
    apart = F.regexp_replace(F.concat(F.lit("\n"), whole), r"(?i)\n((?:#[^\n]*\n)*dn:)", "\n\n$1")
    return ldif.records(apart)


def unreadable(record: Column) -> Column:
    """The lines of an unfolded record that are no comment, no end of an operation and have no colon, or none of whose name is left of it."""
    return F.filter(F.split(record, "\n"), lambda x: (F.btrim(x) != "") & ~x.rlike(r"^#|^-\s*$|^\s*[^:\s][^:]*:"))


def parse_recovering(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with a row for each record of a text, numbered from 0, parsed as far as it can be, with `unreadable`, the lines that were left out, `strict_error`, what a strict reader says, and `recovered`, whether it would refuse the record.

    Any name is taken; a record without one has an error. A null text has no records.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    each = df.select(*others, F.posexplode(recovered_records(F.coalesce(F.col(text), F.lit("")))).alias("record_no", "record"))
    bad = unreadable(F.col("record"))
    kept = F.array_join(F.filter(F.split("record", "\n"), lambda x: ~F.array_contains(F.col("unreadable"), x)), "\n")
    parsed = ldif.parse(each.withColumn("unreadable", bad).withColumn("record", kept))
    lenient = F.when(F.coalesce(F.col("dn"), F.lit("")) == "", F.col("error"))
    return parsed.withColumn("strict_error", F.col("error")).withColumn("error", lenient).withColumn("recovered", F.col("strict_error").isNotNull() | (F.size("unreadable") > 0))


def written_recovering(df: DataFrame, width: int = T.WIDTH) -> DataFrame:
    """`df` with `ldif`: each entry that has a name, whatever it looks like; lines that could not be read stand above it as comments, which `restore_unreadable` takes back. Entries without a name have a null."""
    notes = F.transform(F.coalesce("unreadable", F.array().cast("array<string>")), lambda x: F.concat(F.lit(MARK), x))
    have = F.coalesce("comments", F.array().cast("array<string>")) if "comments" in df.columns else F.array().cast("array<string>")
    out = ldif.written(df.withColumns({"comments": F.concat(have, notes), "attrs": F.col("attrs").cast(ATTRS)}), width, comments=True)
    return out.withColumn("ldif", F.when(F.coalesce("dn", F.lit("")) != "", F.col("ldif")))


def restore_unreadable(df: DataFrame) -> DataFrame:
    """Parsed entries with the lines that `written_recovering` kept as comments back in `unreadable`."""
    marked = lambda c: F.startswith(c, F.lit(MARK))
    lines = F.transform(F.filter("comments", marked), lambda c: F.substr(c, F.lit(len(MARK) + 1)))
    before = F.col("unreadable") if "unreadable" in df.columns else F.array().cast("array<string>")
    return df.withColumns({"unreadable": F.concat(before, lines), "comments": F.filter("comments", lambda c: ~marked(c))})
