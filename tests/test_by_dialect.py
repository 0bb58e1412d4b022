import json

import pytest
from pyspark.sql import functions as F

from dirlake import dialects as D
from dirlake.functions import acl_dialects as L
from dirlake.functions import attrs as A
from dirlake.functions import validate as V
from dirlake.model import ATTRS
from dirlake.operators import by_dialect as B
from dirlake.operators import entries as E
from dirlake.operators import more as M

KINDS = [["person"], ["organizationalUnit"], ["groupOfNames"], ["orclContainer"], ["domain", "top"], ["ndsPerson"], ["USER"], []]
EXTRA = ["cn", "aci", "orclaci", "attributeTypes", "nsslapd-x", "olcX", "description", "photo;binary"]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(f"{rdn},ou=x,dc=y", k, x) for rdn in ("cn=a", "ou=b", "cn=Schema", "cn=users") for k in range(len(KINDS)) for x in range(len(EXTRA))] + [("no name", 0, 0), (None, 1, 1), ("cn=a", 7, None)]
    kind = F.element_at(F.array(*(F.array(*map(F.lit, k)).cast("array<string>") for k in KINDS)), F.col("k") + 1)
    value = F.when(F.col("x") % 3 == 0, "é").otherwise("v")
    attrs = F.concat(F.when(F.size(kind) > 0, F.array(A.attr_of_array("objectClass", kind).cast(ATTRS.removeprefix("array<").removesuffix(">")))).otherwise(F.array().cast(ATTRS)), F.array(F.struct(F.element_at(F.array(*map(F.lit, EXTRA)), F.col("x") + 1).alias("name"), F.array(A.plain_value(value)).alias("values"))).cast(ATTRS))
    return spark.createDataFrame(rows, "dn string, k int, x int").withColumn("attrs", F.when(F.col("x").isNotNull(), attrs).otherwise(F.array().cast(ATTRS))).withColumn("row", F.monotonically_increasing_id()).cache()


def test_a_column_gives_what_a_constant_gives(spark, entries):
    every = entries.crossJoin(spark.createDataFrame([(d,) for d in D.NAMES], "dialect string"))
    got = B.categorize(B.with_rules(every, B.rule_table(spark)), "dc=y").withColumn("v", B.server_violations(F.col("dn"), F.col("attrs"), F.col("rules")))
    got = {(r["row"], r["dialect"]): (r["category"], r["rejection_reason"], r["v"]) for r in got.select("row", "dialect", "category", "rejection_reason", "v").collect()}
    assert len(got) == entries.count() * len(D.NAMES)
    for d in D.NAMES:
        own = E.categorize(entries, d, "dc=y").withColumn("v", V.server_violations(F.col("dn"), F.col("attrs"), d)).select("row", "category", "rejection_reason", "v")
        for r in own.collect():
            assert got[r["row"], d] == tuple(r)[1:], (d, r)


def test_the_first_dialect_with_a_sign_is_found(spark, entries):
    signs = {d: {r["row"] for r in entries.where(M.looks_like(F.col("dn"), F.col("attrs"), d)).collect()} for d in D.SIGNATURES}
    got = {r["row"]: r["dialect"] for r in B.detect_entries(entries, B.rule_table(spark)).collect()}
    assert got == {row: next((d for d in D.SIGNATURES if row in signs[d]), "rfc") for row in got} and len(set(got.values())) > 4


def test_rules_from_files_and_rules_that_are_added(spark, entries, tmp_path):
    (tmp_path / "rules.json").write_text("\n".join(json.dumps(x) for x in (
        {"dialect": "mine", "requires": ["naming"], "categories": [{"name": "things", "classes": ["Person"], "attributes": ["DESCRIPTION"]}], "checks": [{"rule": "forbids", "attribute": "aci", "object_class": None}]},
        {"dialect": "rfc", "checks": [{"rule": "requires", "attribute": "sn", "object_class": "PERSON"}, {"rule": "unknown", "attribute": "x"}, {"rule": "requires", "attribute": None}]},
    )))
    rules = B.injected(B.rule_table(spark), B.read_rules(spark, str(tmp_path)))
    assert rules.count() == len(D.NAMES) + 1
    every = entries.crossJoin(spark.createDataFrame([("mine",), ("RFC",), ("none",), (None,)], "dialect string"))
    got = B.categorize(B.with_rules(every, rules)).withColumn("v", B.server_violations(F.col("dn"), F.col("attrs"), F.col("rules"))).where("dn is not null and x is not null").collect()
    for r in got:
        kinds, extra = KINDS[r["k"]], EXTRA[r["x"]]
        if r["dialect"] == "mine" and r["dn"] != "no name":
            assert ("Server forbids attribute 'aci'" in r["v"]) == (extra == "aci")
            if extra != "attributeTypes":
                assert r["category"] == ("things" if kinds == ["person"] or extra == "description" else "rejected")
        elif r["dialect"] in ("RFC", None):
            assert r["v"] == (["Server requires attribute 'sn' of class 'PERSON'"] if kinds == ["person"] else [])
        else:
            assert r["v"] == []


def test_large_rule_tables_are_not_broadcast(spark, entries, monkeypatch):
    few = B.with_rules(entries.withColumn("dialect", F.when(F.col("k") > 3, "oud").otherwise("oid")), B.rule_table(spark))
    monkeypatch.setattr(B, "MOST_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = B.with_rules(entries.withColumn("dialect", F.when(F.col("k") > 3, "oud").otherwise("oid")), B.rule_table(spark))
        assert "BroadcastHashJoin" in few._jdf.queryExecution().toString() and "BroadcastHashJoin" not in many._jdf.queryExecution().toString()
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spellings_and_rules_of_access(spark):
    names = ["OracleOID", " oud ", None, "edirectory", "389ds", "whatever"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(B.resolved(F.col("n"))).collect()
    assert [r[0] for r in got] == ["oid", "oud", "rfc", "novell", "ds389", "whatever"]
    line = 'access to attr=(cn) by group="cn=g" (read)'
    rows = spark.createDataFrame([(d, line) for d in D.NAMES] + [("oid", None)], "d string, line string").select("d", "line", L.parse_acl_by(F.col("line"), F.col("d")).alias("p")).collect()
    for r in rows:
        assert r["p"] == (spark.range(1).select(L.parse_acl(F.lit(line), r["d"])).first()[0] if r["line"] else None)


def test_empty_tables(spark, entries):
    none = entries.limit(0)
    rules = B.rule_table(spark)
    assert B.acl_entries(B.categorize(B.with_rules(B.detect_entries(none, rules), rules))).count() == 0
    bare = B.with_rules(B.detect_entries(entries, rules.limit(0)), rules.limit(0))
    assert {(r["dialect"], r["rules"]) for r in bare.collect()} == {("rfc", None)} and set(r[0] for r in B.categorize(bare).select("category").distinct().collect()) <= {"schema", "rejected"}
