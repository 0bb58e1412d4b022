"""Counts that come with a run: observed on the rows that are written, without reading anything for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: All categories that an entry can have.
CATEGORIES = ("schema", "hierarchy", "users", "groups", "acl", "rejected")
#: What opens a reason of rejection, and the name under which it is counted.
_FILE = "_source_"
REASONS = {"Invalid DN": "invalid_dn", "No category match": "no_match", "DN not under base DN": "outside"}


def _measures(df: DataFrame, categories: Sequence[str]) -> dict[str, Column]:
    have = set(df.columns)
    one: dict[str, Column] = {"entries": F.count(F.lit(1))}
    if "category" in have:
        one |= {f"category_{c}": F.count_if(F.col("category") == c) for c in categories}
    if "rejection_reason" in have:
        one |= {f"reason_{name}": F.count_if(F.startswith("rejection_reason", F.lit(text))) for text, name in REASONS.items()}
    if "error" in have:
        one["failed"] = F.count_if(F.col("error").isNotNull())
    if "attrs" in have:
        one["values"] = F.coalesce(F.sum(F.aggregate("attrs", F.lit(0).cast("bigint"), lambda n, a: n + F.size(a["values"]))), F.lit(0))
    return one


def observed(df: DataFrame, name: str, categories: Sequence[str] = CATEGORIES, sources: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """(df, observation): `df` unchanged, and counts of its rows that are there once it has been written: entries, values of attributes, entries of each category and reason of
    rejection, entries with an error; those whose column is missing are left out. `sources` are values of `source` that are counted one by one, with their rejected entries. Only rows that pass are counted, so a plan that runs once is counted once."""
    seen = Observation(name)
    measures = _measures(df, categories)
    for k, x in enumerate(sources):
        measures |= {f"{_FILE}{k}": F.count_if(F.col("source") == x), f"{_FILE}{k}_rejected": F.count_if((F.col("source") == x) & (F.col("category") == "rejected"))}
    return df.observe(seen, *(c.alias(k) for k, c in measures.items())), seen


def report(spark: SparkSession, seen: Observation) -> DataFrame:
    """(metric, n) of an observation whose rows have been written, and `success_rate`, the percentage of entries that were not rejected, times 100; 10000 without entries."""
    got = {k: int(v or 0) for k, v in seen.get.items() if not k.startswith(_FILE)}
    n = got.get("entries", 0)
    rate = round(10000 * (n - got.get("category_rejected", 0)) / n) if n else 10000
    return spark.createDataFrame([*got.items(), ("success_rate", rate)], "metric string, n bigint")


def by_source(spark: SparkSession, seen: Observation, sources: Sequence[str]) -> DataFrame:
    """(source, entries, rejected, success_rate) of the observed sources that have entries, and a row of all with a null source, if there are any."""
    got = seen.get
    rows = [(x, int(got[f"{_FILE}{k}"]), int(got[f"{_FILE}{k}_rejected"])) for k, x in enumerate(sources)]
    rows = [(x, n, bad, round(100.0 * (n - bad) / n, 2)) for x, n, bad in [*rows, (None, sum(r[1] for r in rows), sum(r[2] for r in rows))] if n]
    return spark.createDataFrame(rows, "source string, entries bigint, rejected bigint, success_rate double")
