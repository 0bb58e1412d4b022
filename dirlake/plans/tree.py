"""The driver's tables as a directory tree: regions and nations as units, customers as people, suppliers as groups, parts as devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import attrs as A
from dirlake.model import ATTRS

BASE = "dc=example,dc=com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classes(*names: str) -> Column:
    return A.attr("objectClass", *(F.lit(n) for n in names))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, n_name, r_name, unit): 25 rows in every size, so a join with it is a broadcast by its statistics."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.concat(F.lit("ou="), "n_name", F.lit(",ou="), "r_name", F.lit("," + BASE)).alias("unit"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person for each customer."""
    c = table(spark, sf_dir, "customer").join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    attrs = A.entry_attrs(_classes("top", "person", "organizationalPerson", "inetOrgPerson"), A.attr("cn", F.col("c_name")), A.attr("sn", F.col("c_name")), A.attr("employeeNumber", F.col("c_custkey").cast("string")), A.attr("businessCategory", F.col("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("record_no"), F.concat(F.lit("cn="), "c_name", F.lit(","), "unit").alias("dn"), attrs.alias("attrs"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group for each supplier, whose manager names a unit."""
    s = table(spark, sf_dir, "supplier").join(nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    attrs = A.entry_attrs(_classes("top", "groupOfNames"), A.attr("cn", F.col("s_name")), A.attr("member", F.concat(F.lit("cn=Manager,"), F.col("unit"))))
    return s.select(F.col("s_suppkey").alias("record_no"), F.concat(F.lit("cn="), "s_name", F.lit(","), "unit").alias("dn"), attrs.alias("attrs"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device for each part; no category takes it."""
    p = table(spark, sf_dir, "part")
    attrs = A.entry_attrs(_classes("top", "device"), A.attr("cn", F.col("p_name")), A.attr("serialNumber", F.col("p_partkey").cast("string")))
    return p.select(F.col("p_partkey").alias("record_no"), F.concat(F.lit("serialNumber="), F.col("p_partkey").cast("string"), F.lit(",ou=Parts," + BASE)).alias("dn"), attrs.alias("attrs"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions and nations."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("record_no"), F.concat(F.lit("ou="), "r_name", F.lit("," + BASE)).alias("dn"), F.col("r_name").alias("ou"))
    n = nations(spark, sf_dir).select(F.col("n_nationkey").cast("bigint") + 100, "unit", "n_name")
    return r.union(n).select("record_no", "dn", A.entry_attrs(_classes("top", "organizationalUnit"), A.attr("ou", F.col("ou"))).alias("attrs"))


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries (kind, record_no, dn, attrs)."""
    sources = {"unit": units, "customer": customers, "supplier": suppliers, "part": parts}
    out = None
    for kind, make in sources.items():
        own = make(spark, sf_dir).select(F.lit(kind).alias("kind"), "record_no", "dn", F.col("attrs").cast(ATTRS).alias("attrs"))
        out = own if out is None else out.unionByName(own)
    return out
