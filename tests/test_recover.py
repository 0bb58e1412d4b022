import pytest
from pyspark.sql import functions as F

from dirlake.functions import bind_rules as B
from dirlake.functions import tables
from dirlake.operators import compat as C
from dirlake.operators import metrics
from dirlake.sources import ldif
from dirlake.sources import recover as R


def read(spark, text):
    return [r.asDict(recursive=True) for r in R.parse_recovering(spark.createDataFrame([(text, 1)], "text string, unrelated int")).orderBy("record_no").collect()]


def test_what_a_strict_reader_reads_is_read_alike(spark):
    text = "version: 1\n\n# c\ndn: cn=a\ncn: a\n b\n\ndn:: Y249asOp\ndescription:: IHg=\nurl:< http://x\n\n\ndn: cn=m\nchangetype: modify\nadd: x\nx: 1\n-\n\ndn: broken\ncn: b"
    strict = [r.asDict(recursive=True) for r in ldif.parse_text(spark.createDataFrame([(text,)], "text string")).orderBy("record_no").collect()]
    for a, b in zip(strict, read(spark, text), strict=True):
        assert b["strict_error"] == a["error"] and b["unreadable"] == [] and b["unrelated"] == 1 and b["recovered"] == (a["error"] is not None)
        assert {k: v for k, v in a.items() if k != "error"} == {k: b[k] for k in a if k != "error"}
    assert [b["error"] for b in read(spark, text)] == [None] * 4


def test_records_without_blank_lines_and_odd_line_ends(spark):
    got = read(spark, "dn: cn=a\rcn: a\r\rdn: cn=b\r\ncn: b\r\nlost line\r\n  folded\r\n# about c\r\nDN: cn=c\ncn: c\n \n   dn: cn=d\nnothing\n:\n: x\ncn: d")
    assert [(e["dn"], e["unreadable"], e["comments"]) for e in got] == [("cn=a", [], []), ("cn=b", ["lost line folded"], []), ("cn=c", [], ["about c"]), ("cn=d", ["nothing", ":", ": x"], [])]
    assert read(spark, "") == [] and read(spark, "\n \n") == [] and read(spark, None) == []
    (e,) = read(spark, "cn: a")
    assert e["error"] == "no dn" and e["recovered"]


def test_written_leniently_and_read_again(spark):
    text = "dn: 2.5.4.3=é\nbad\n# note\ncn: a\nworse line\n\ndn: cn=b\ncn: b\n\ncn: nameless"
    first = R.parse_recovering(spark.createDataFrame([(text,)], "text string"))
    out = {r["record_no"]: r["ldif"] for r in R.written_recovering(first).collect()}
    assert out[2] is None and out[1] == "dn: cn=b\ncn: b" and out[0].split("\n")[:3] == ["# note", "# unreadable: bad", "# unreadable: worse line"]
    again = R.restore_unreadable(R.parse_recovering(spark.createDataFrame([("\n\n".join(out[k] for k in (0, 1)),)], "text string"))).orderBy("record_no").collect()
    assert [(r["dn"], r["unreadable"], r["comments"]) for r in again] == [("2.5.4.3=é", ["bad", "worse line"], ["note"]), ("cn=b", [], [])]


def test_table_functions_give_what_the_columns_give(spark):
    tables.register(spark)
    texts = ["version: 1\n\ndn: cn=a\ncn: a\n b\n\n\ndn: cn=m\nchangetype: modify\nadd: x\nx:: IHg=\n-\n", "dn: cn=c\r\ncn: c\r\n\r\nbroken", "", None, "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    df.createOrReplaceTempView("ldif_texts_of_a_test")
    got = spark.sql("SELECT k, e.* FROM ldif_texts_of_a_test, LATERAL parse_ldif(text) e").collect()
    want = ldif.parse_text(df).select("k", *[c for c in spark.sql("SELECT * FROM parse_ldif('')").columns]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 4
    acis = ['(version 3.0; acl "a;b"; allow (read, Write) userdn="ldap:///x;y" and not ip="1"; deny(all) (ip="2";)', "none", None]
    spark.createDataFrame([(a,) for a in acis], "aci string").createOrReplaceTempView("acis_of_a_test")
    got = [r.asDict(recursive=True) for r in spark.sql("SELECT a.* FROM acis_of_a_test, LATERAL parse_acl(aci) a").collect()]
    assert [(r["name"], r["kind"], r["permissions"], r["rule"], r["error"]) for r in got] == [("a;b", "allow", ["read", "write"], 'userdn="ldap:///x;y" and not ip="1"', None), ("a;b", "deny", ["all"], '(ip="2"', "bracket is not closed")]
    assert got[0]["steps"] == B.postfix('userdn="ldap:///x;y" and not ip="1"')[0] and got[1]["steps"] is None


def test_migration_reads_its_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a b.ldif", 5), ("c.ldif", 3)):
        (tmp_path / "in" / name).write_text("".join(f"dn: cn={k},o=x\nobjectClass: person\ncn: {k}\n\n" for k in range(n)) + "dn: broken\ncn: b\n")
    options = {"source_base": "o=x", "target_base": "o=y"}
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    found, counts = C.migrate_observed(spark, str(tmp_path / "in"), str(tmp_path / "out"), "oid", "oud", **options)
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup()) - set(before)
    assert len(jobs) <= 1  # one write, whose rows are counted on the way
    got = {r["metric"]: r["n"] for r in counts.collect()}
    assert (got["entries"], got["category_users"], got["category_rejected"], got["reason_invalid_dn"], got["failed"], got["success_rate"]) == (10, 8, 2, 2, 2, 8000)
    rows = sorted(((r["source"] or "").rpartition("/")[2], r["entries"], r["rejected"], r["success_rate"]) for r in found.collect())
    assert rows == [("", 10, 2, 80.0), ("a b.ldif", 6, 1, 83.33), ("c.ldif", 4, 1, 75.0)]
    with pytest.raises(Exception, match="(?i)exists"):
        C.migrate_observed(spark, str(tmp_path / "in"), str(tmp_path / "out"), "oid", "oud", **options)
    again, _ = C.migrate_observed(spark, str(tmp_path / "in"), str(tmp_path / "out"), "oid", "oud", mode="overwrite", by_file=True, **options)
    assert sorted((r["source"] or "", r["entries"], r["rejected"], r["success_rate"]) for r in again.collect()) == rows
    assert ldif.read_ldif(spark, str(tmp_path / "out" / "category=users" / "file=c.ldif")).count() == 3


def test_observed_columns_that_are_missing(spark):
    df, seen = metrics.observed(spark.range(3), "three")
    df.write.format("noop").mode("overwrite").save()
    assert {r["metric"]: r["n"] for r in metrics.report(spark, seen).collect()} == {"entries": 3, "success_rate": 10000}
