import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dirlake.functions import attrs as A
from dirlake.functions import text as T
from dirlake.operators import compat as C
from dirlake.operators import entries as E
from dirlake.sources import ldif


def parsed(spark, text):
    return [r.asDict(recursive=True) for r in ldif.parse_text(spark.createDataFrame([(text,)], "text string")).orderBy("record_no").collect()]


def values(entry, name):
    return [v["value"] for a in entry["attrs"] if a["name"] == name for v in a["values"]]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_folds_version_comments_and_blank_lines(spark, end):
    lines = ["version: 1", "# about", "dn: cn=a,dc=x", "cn: a", "description: one", "  two", "\tthree", "", "", "dn: cn=b,dc=x", "cn: b", ""]
    a, b = parsed(spark, end.join(lines))
    assert values(a, "description") == ["one twothree"] and a["comments"] == ["about"] and values(b, "cn") == ["b"]


def test_value_forms(spark):
    (e,) = parsed(spark, "dn:: Y249asOpLGRjPXg=\ncn:: asOp\nbad:: !!\nphoto:< file:///x\nurl:< http://y\nempty:\nspaced: :aGk=\n")
    assert e["dn"] == "cn=jé,dc=x" and values(e, "cn") == ["jé"] and values(e, "bad") == ["!!"] and values(e, "empty") == [""]
    assert [v["origin"] for a in e["attrs"] for v in a["values"]] == ["base64", "base64", "file", "url", "plain", "base64"]


def test_last_dn_counts_and_bad_records_stay(spark):
    a, b, c = parsed(spark, "dn: cn=a\ndn: cn=b\ncn: x\n\ncn: y\n\ndn: 2.5.4.3=z\ncn: z\n")
    assert a["dn"] == "cn=b" and a["error"] is None and b["error"] == "no dn" and c["error"].startswith("invalid dn")


def test_unknown_change_is_content(spark):
    (e,) = parsed(spark, "dn: cn=a\nchangetype: bogus\ncn: a\n")
    assert e["changetype"] is None and e["record_kind"] == "content"


def test_change_records_round_trip(spark):
    text = "dn: cn=a\nchangetype: modify\nadd: mail\nmail: x\nmail: y\n-\ndelete: fax\n-\nincrement: n\nn: 2\n-"
    first = ldif.parse_text(spark.createDataFrame([(text,)], "text string"))
    again = ldif.parse_text(ldif.written(first).select(F.col("ldif").alias("text")))
    assert first.select("dn", "changetype", "change_ops").collect() == again.select("dn", "changetype", "change_ops").collect()
    assert [o["op"] for o in again.first()["change_ops"]] == ["add", "delete", "increment"]


def test_written_again_byte_by_byte(spark):
    texts = ["dn: cn=a\nphoto:: /9j/4AAB\nsn:: ICBsZWFkIA==\ncn: a", "dn: cn=a\ncontrol: 1.2 true:< http://a/b\nchangetype: delete", "dn: cn=a\nchangetype: modify\nadd: x\nx:: IHkg\n-", "dn: cn=a\nl: " + "w" * 200]
    got = ldif.written(ldif.parse_text(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()
    assert [T.unfold_text(r["ldif"]) for r in got] == texts and [r["record_no"] for r in got] == [0] * 4


def test_files_of_both_line_ends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = "dn: cn=a\ncn: a\n\ndn: cn=b\ncn: b\n b\n\n\ndn: cn=c\ncn: c\n"
    (tmp_path / "in" / "a.ldif").write_bytes(one.encode())
    (tmp_path / "in" / "b.ldif").write_bytes(one.replace("\n", "\r\n").encode())
    (tmp_path / "in" / "c.ldif").write_bytes(b"")
    got = ldif.read_ldif(spark, str(tmp_path / "in"), number=True).select(F.element_at(F.split("source", "/"), -1).alias("f"), "record_no", "dn", A.first_value(F.col("attrs"), "cn").alias("cn")).collect()
    want = [(f, k, f"cn={x}", x * (2 if x == "b" else 1)) for f in ("a.ldif", "b.ldif") for k, x in enumerate("abc")]
    assert sorted(map(tuple, got)) == want
    # a file that ends its lines with carriage returns is still many blocks
    assert spark.read.text(str(tmp_path / "in" / "b.ldif"), lineSep="\r\n\r\n").count() > 1
    with pytest.raises(FileNotFoundError):
        ldif.read_ldif(spark, str(tmp_path / "none.ldif"))


def test_version_line_and_comments(spark, tmp_path):
    e = ldif.parse_text(spark.createDataFrame([("# note\ndn: cn=a\ncn: a",)], "text string"))
    ldif.write_ldif(e, str(tmp_path / "out"), version=True, comments=True)
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == "version: 1\n\n# note\ndn: cn=a\ncn: a\n\n"
    assert ldif.read_ldif(spark, str(tmp_path / "out")).count() == 1


def test_places_over_all_rows(spark):
    df = spark.range(200).selectExpr("id", "id * 37 % 200 as k").repartition(5)
    assert [(r.k, r.place) for r in E.ranked(df, F.col("k")).orderBy("place").collect()] == [(i, i + 1) for i in range(200)]
    assert E.ranked(df.limit(0), F.col("k")).count() == 0


def test_files_migrated(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ldif").write_text("dn: cn=a,o=x\nobjectClass: person\ncn: a\norclguid: 1\norclaci: access to entry by self (browse)\n\ndn: broken\ncn: b\n")
    got = C.migrate_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "oid", "oud", source_base="o=x", target_base="o=y").collect()
    assert sorted((r.source is None, r.entries, r.rejected, r.success_rate) for r in got) == [(False, 2, 1, 50.0), (True, 2, 1, 50.0)]
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("category=acl/part-*"))
    assert "dn: cn=a,o=y" in text and 'aci: (targetattr="*")' in text and "entryuuid: 1" in text.lower() and (tmp_path / "out" / "category=rejected").is_dir()


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("\n\n \n",)], "text string")
    assert ldif.parse_text(df).count() == 0
    assert ldif.parse(spark.createDataFrame([(None,)], "record string")).first()["error"] == "no dn"


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_characters="\n\r", exclude_categories=("Cs",)), max_size=300), st.integers(20, 90))
def test_folding_is_narrow_and_lossless(value, width):
    line = "description: " + value
    folded = T.fold_text(line, width).split("\n")
    assert all(len(x.encode()) <= width for x in folded)
    assert folded[0] + "".join(x[1:] for x in folded[1:]) == line and all(x[0] == " " for x in folded[1:])


def test_file_round_trip_with_many_splits(spark, tmp_path):
    rows = [(f"cn=u{i},dc=x", i, " lead" if i % 3 == 0 else "é" * (i % 90) + " word" * (i % 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "dn string, record_no int, text string").select("record_no", "dn", A.entry_attrs(A.attr("cn", F.col("record_no").cast("string")), A.attr("description", F.col("text"))).alias("attrs"))
    ldif.write_ldif(df.repartition(3), str(tmp_path / "out"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = ldif.read_ldif(spark, str(tmp_path / "out"))
        got = {r["dn"]: r["d"] for r in back.select("dn", A.first_value(F.col("attrs"), "description").alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {dn: (t.strip() or None) for dn, _, t in rows}


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ldif").write_text("dn: cn=a\ncn: a\n\ndn: cn=b\ncn: b\n")
    stream = ldif.read_ldif_stream(spark, str(tmp_path / "in"))
    run = stream.writeStream.format("memory").queryName("ldif_files").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["dn"] for r in spark.table("ldif_files").select("dn").collect()) == ["cn=a", "cn=b"]


def test_empty_tables(spark):
    empty = ldif.parse_text(spark.createDataFrame([], "text string"))
    assert E.categorize(empty, "oud", base="dc=x").count() == 0 and ldif.written(empty).count() == 0
    assert E.difference(empty, empty).count() == 0 and E.object_class_counts(empty).count() == 0
