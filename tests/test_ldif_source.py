import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dirlake.functions import attrs as A
from dirlake.model import ATTRS
from dirlake.sources import ldif
from dirlake.sources import ldif_source as S

LINES = st.lists(st.sampled_from([b"dn: a", b"x: y", b" z", b"", b"", b" "]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(LINES, st.sampled_from([b"\n", b"\r\n"]), st.booleans(), st.integers(1, 9), st.integers(1, 5))
def test_ranges_own_each_record_once(lines, end, ended, step, chunk):
    raw = end.join(lines) + (end if ended else b"")
    whole = [x for x in S.blocks(io.BytesIO(raw), 0, 1 << 60) if x[1].strip()]
    old, S.CHUNK = S.CHUNK, chunk
    try:
        got = []
        for lo in range(0, max(1, len(raw)), step):
            f = io.BytesIO(raw)
            back = min(2, lo)
            f.seek(lo - back)
            got += [x for x in S.blocks(f, lo, lo + step, f.read(back) if back else b"") if x[1].strip()]
    finally:
        S.CHUNK = old
    assert got == whole


def people(spark, n=300):
    text = F.concat(F.lit(" "), F.repeat(F.lit("wörd "), (F.col("id") % 40).cast("int")))
    attrs = A.entry_attrs(A.attr("cn", F.col("id").cast("string")), A.attr("description", text)).cast(ATTRS)
    return spark.range(n).select(F.concat(F.lit("cn=u"), F.col("id"), F.lit(",dc=x")).alias("dn"), attrs.alias("attrs"))


def shown(df):
    return sorted((r["dn"], r["d"]) for r in df.select("dn", A.first_value(F.col("attrs"), "description").alias("d")).collect())


def test_write_and_read_with_small_ranges(spark, tmp_path):
    S.register(spark)
    path, df = str(tmp_path / "a b%1[x]{y}"), people(spark)
    df.repartition(3).write.format("ldif").mode("append").save(path)
    df.repartition(2).write.format("ldif").mode("append").option("crlf", "true").option("version", "true").option("width", "40").save(path)
    assert len(list((tmp_path / "a b%1[x]{y}").glob("part-*"))) == 5 and not list((tmp_path / "a b%1[x]{y}").glob("_temporary*"))
    want = sorted(2 * [(r["dn"], r["d"]) for r in df.select("dn", F.trim(A.first_value(F.col("attrs"), "description")).alias("d")).collect()])
    for step in (97, 4096, 1 << 25):
        assert shown(spark.read.format("ldif").option("rangebytes", step).load(path)) == want
    df.limit(5).write.format("ldif").mode("overwrite").save(path)
    assert spark.read.format("ldif").load(path).count() == 5


@pytest.mark.parametrize("name", ["a b%1.ldif", "a[1].ldif", "a*.ldif", "ü?.ldif"])
def test_names_that_look_like_something_else(spark, tmp_path, name):
    (tmp_path / name).write_bytes(b"dn: cn=a\r\ncn: a\r\n\r\ndn: cn=b\r\ncn: b\r\n")
    (tmp_path / "other.ldif").write_bytes(b"dn: cn=z\ncn: z\n")
    for path in (str(tmp_path / name), f"file://{tmp_path / name}", f"file:{tmp_path / name}"):
        assert sorted(r["dn"] for r in ldif.read_ldif(spark, path).collect()) == ["cn=a", "cn=b"]
    assert ldif.read_ldif(spark, str(tmp_path / "*.ldif")).count() == 3
    assert {r["source"] for r in ldif.read_ldif(spark, str(tmp_path)).collect()} == {f"file://{tmp_path / name}", f"file://{tmp_path / 'other.ldif'}"}


def test_patterns_hidden_files_and_folders(spark, tmp_path):
    for k, name in enumerate(["in/x1/a.ldif", "in/x2/b.ldif", "in/y/c.ldif", "in/x1/_d.ldif", "in/.e/f.ldif"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"dn: cn={k}\ncn: {k}\n")
    count = lambda path: ldif.read_ldif(spark, str(tmp_path / path)).count()
    assert (count("in"), count("in/x*"), count("in/*/a.ldif"), count("in/[xy]?/*.ldif")) == (3, 2, 1, 3)
    for path in ("none", "in/z*", "in/*/z.ldif"):
        with pytest.raises(FileNotFoundError):
            ldif.read_ldif(spark, str(tmp_path / path))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        ldif.read_ldif(spark, str(tmp_path / "empty"))


def test_encodings_and_compressed_files(spark, tmp_path):
    text = "﻿version: 1\n\ndn: cn=é\ncn: é\n\n\n  \ndn: cn=ß\ncn: ß\n"
    (tmp_path / "a.ldif").write_text(text[1:], encoding="utf-16")
    (tmp_path / "b.ldif").write_text(text[1:], encoding="latin-1")
    (tmp_path / "c.ldif.gz").write_bytes(gzip.compress(text.encode()))
    for name, encoding in (("a.ldif", "utf-16"), ("b.ldif", "latin-1"), ("c.ldif.gz", "UTF-8")):
        got = spark.read.format("ldif").options(encoding=encoding, rangebytes=7).load(str(tmp_path / name)).orderBy("record_no").collect()
        assert [(r["dn"], r["error"]) for r in got] == [("cn=é", None), ("cn=ß", None)]


def test_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "a.ldif").write_text("\n\n".join(f"dn: cn={k}\ncn: {'x' * (k % 50)}" for k in range(500)))
    got = ldif.numbered(spark.read.format("ldif").option("rangebytes", 100).load(str(tmp_path / "a.ldif")), block=256)
    assert sorted((r["record_no"], r["dn"]) for r in got.collect()) == [(k, f"cn={k}") for k in range(500)]
    assert got.columns == ldif.read_ldif(spark, str(tmp_path)).columns


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    S.register(spark)
    path = str(tmp_path / "out")
    people(spark, 5).write.format("ldif").mode("append").save(path)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    broken = people(spark, 100).withColumn("dn", F.when(F.col("dn") == "cn=u77,dc=x", F.raise_error(F.lit("stop"))).otherwise(F.col("dn")))
    with pytest.raises(PySparkException):
        broken.repartition(4).write.format("ldif").mode("overwrite").save(path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    with pytest.raises(PySparkException, match="attrs is"):
        people(spark).withColumn("attrs", F.lit("x")).write.format("ldif").mode("append").save(path)
    people(spark, 0).write.format("ldif").mode("append").save(str(tmp_path / "none"))
    assert (tmp_path / "none" / "_SUCCESS").exists()
