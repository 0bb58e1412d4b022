"""Table functions for SQL texts: `parse_ldif` and `parse_acl`, usable in LATERAL.

LATERAL takes no Arrow table functions, and a table function of Python runs once for each row. So both are SQL functions over columns, which Spark puts
into the calling plan: texts are cut and parsed by functions over whole Arrow columns there, as everywhere else.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dirlake.functions import bind_rules as B
from dirlake.functions import records as R

_NAME = re.compile(r'(?i)\bacl\s+"([^"]*)"')
_CLAUSE = re.compile(r'(?is)\b(allow|deny)\s*\(([^)]*)\)\s*((?:[^;"]|"[^"]*")*);')
CLAUSE = f"struct<name: string, kind: string, permissions: array<string>, rule: string, steps: {B.STEPS}, error: string>"
_CLAUSES = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("permissions", pa.list_(pa.string())), ("rule", pa.string()), ("steps", pa.list_(B._STEP)), ("error", pa.string())]))
#: `dirlake.sources.ldif.records` in SQL.
_RECORDS = r"""filter(
    transform(
        split(regexp_replace(regexp_replace(coalesce(text, ''), r'\r\n', char(10)), r'(?<=[^\n])\n[ \t]', ''), r'\n[ \t]*(?:\n[ \t]*)+'),
        b -> regexp_replace(btrim(b, char(10)), r'(?i)^version:[^\n]*(?:\n+|$)', '')),
    b -> b RLIKE r'[^ \t\n\r\x0B\f]')"""


def _cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield R._entries(texts)


def _clauses(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The clauses of each instruction; instructions and rules that repeat in a batch are parsed once."""
    for acis in batches:
        coded, postfix = acis.dictionary_encode(), functools.cache(B.postfix)
        found = []
        for aci in coded.dictionary.to_pylist():
            name, own = _NAME.search(aci), []
            for kind, permissions, rule in _CLAUSE.findall(aci):
                steps, error = postfix(rule)
                named = [p for p in (x.strip().lower() for x in permissions.split(",")) if p]
                own.append({"name": name and name[1], "kind": kind.lower(), "permissions": named, "rule": rule.strip(), "steps": steps, "error": error})
            found.append(own)
        yield pa.array(found, _CLAUSES).take(coded.indices)


def _columns(struct: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(struct.removeprefix("struct<").removesuffix(">")))


def register(spark: SparkSession) -> None:
    """Make both functions known to a session's SQL.

    `parse_ldif(text)`: (record_no, ...) the entries of an LDIF text, as `dirlake.sources.ldif.parse_text` gives them; none of a null.
    `parse_acl(aci)`: (name, kind, permissions, rule, steps, error) the clauses of an access control instruction, each bind rule as postfix steps; none of a null or of a text without clauses.
    """
    spark.udf.register("dirlake_entry", F.arrow_udf(_cut, R.ENTRY))
    spark.udf.register("dirlake_clauses", F.arrow_udf(_clauses, f"array<{CLAUSE}>"))
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} parse_ldif(text STRING) RETURNS TABLE(record_no BIGINT, {_columns(R.ENTRY)}) RETURN SELECT pos, e.* FROM (SELECT pos, dirlake_entry(col) AS e FROM posexplode({_RECORDS}))")
    spark.sql(f"{make} parse_acl(aci STRING) RETURNS TABLE({_columns(CLAUSE)}) RETURN SELECT c.* FROM explode(dirlake_clauses(aci)) AS t(c)")
