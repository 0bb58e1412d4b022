import pytest
from pyspark.sql import functions as F

from dirlake.sources import ldif
from dirlake.streaming import replay as P


class Log:
    def __init__(self, spark, path):
        self.spark, self.path, self.seq = spark, path, 0

    def add(self, *texts, seq=None):
        e = ldif.parse(self.spark.createDataFrame([(self.seq + k if seq is None else seq[k], t) for k, t in enumerate(texts)], "seq bigint, record string"))
        self.seq += len(texts)
        e.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60)).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return e.schema

    def replayed(self, retain=None):
        schema = self.spark.read.parquet(f"{self.path}/log").schema
        stream = self.spark.readStream.schema(schema).parquet(f"{self.path}/log")
        entries, renames = P.replay(self.spark, P.records(stream, time="ts"), f"{self.path}/work", retain)
        found = P.current_names(entries, renames).collect()
        return {(r["dn"], r["key"].count("\t")): (r["present"], r["changes"], {a["name"]: a["values"] for a in r["attrs"]}) for r in found}


def test_renames_move_subtrees_and_free_their_names(spark, tmp_path):
    log = Log(spark, tmp_path)
    log.add(
        "dn: ou=A,dc=x\nchangetype: add\nou: A", "dn: uid=1,ou=a,dc=x\nchangetype: add\ncn: one\nn: 5", "dn: ou=A,dc=x\nchangetype: modrdn\nnewrdn: ou=B\ndeleteoldrdn: 1",
        "dn: UID=1, ou=B,dc=x\nchangetype: modify\nadd: mail\nmail: x\nmail: y\n-\nincrement: n\nn: 2\n-", "dn: ou=a,dc=x\nchangetype: add\nou: a2", "dn: uid=1,ou=a,dc=x\nchangetype: add\ncn: other",
    )
    assert log.replayed()["uid=1,ou=b,dc=x", 0] == (True, 2, {"cn": ["one"], "mail": ["x", "y"], "n": ["7"]})
    log.add(
        "dn: ou=b,dc=x\nchangetype: modrdn\nnewrdn: ou=C\ndeleteoldrdn: 1", "dn: uid=1,ou=C,dc=x\nchangetype: modify\ndelete: mail\nmail: x\n-\nreplace: cn\ncn: ONE\n-\ndelete: n\n-",
        "dn: uid=1,ou=a,dc=x\nchangetype: delete", "dn: dc=x\nchangetype: modrdn\nnewrdn: dc=y\ndeleteoldrdn: 0", "dn: ou=c,dc=y\nchangetype: moddn\nnewrdn: ou=A+l=z\ndeleteoldrdn: 0",
    )
    got = log.replayed()
    assert got["uid=1,ou=a+l=z,dc=y", 0] == (True, 3, {"cn": ["ONE"], "mail": ["y"]})
    assert got["ou=a+l=z,dc=y", 0][2]["ou"] == ["C", "A+l=z"] and got["ou=a,dc=y", 1] == (True, 1, {"ou": ["a2"]})
    assert got["uid=1,ou=a,dc=y", 1] == (False, 2, {}) and len(got) == 5


def test_order_repeats_and_what_cannot_be(spark, tmp_path):
    log = Log(spark, tmp_path)
    log.add("dn: cn=a\nchangetype: modify\nadd: x\nx: early\n-", "dn: cn=a\nchangetype: add\nx: 1\nx: 1\nX: 2", "dn: cn=a\nchangetype: add\nx: again", "dn: cn=a\nchangetype: modify\nincrement: x\nx: 1\n-\nincrement: x\nx: word\n-\nadd: x\nx: 3\n-", "cn: no name", "dn: cn=b\ncn: content")
    log.add("dn: cn=a\nchangetype: modify\nreplace: x\n-\nreplace: y\ny: late\n-", "dn: cn=c\nchangetype: modrdn\nnewrdn: cn=d\ndeleteoldrdn: 1\nnewsuperior: ou=z", seq=[2, 9])
    got = log.replayed()
    # the older record only counts; adding twice and changing what is not there change nothing
    assert got == {("cn=a", 0): (True, 5, {"x": ["2", "3"]}), ("cn=b", 0): (True, 1, {"cn": ["content"]}), ("cn=c", 0): (False, 1, {})}


def test_deleted_entries_are_forgotten_by_a_timer(spark, tmp_path):
    log = Log(spark, tmp_path)
    log.add("dn: cn=a\nchangetype: add\nx: 1", "dn: cn=a\nchangetype: delete", "dn: cn=b\nchangetype: add\nx: 1", seq=[1, 2, 3])
    assert log.replayed(retain=600)["cn=a", 0] == (False, 2, {})
    log.add("dn: cn=b\nchangetype: modify\nadd: x\nx: 2\n-", seq=[500])
    log.replayed(retain=600)
    log.add("dn: cn=b\nchangetype: modify\nadd: x\nx: 3\n-", "dn: cn=a\nchangetype: add\nx: new", seq=[900, 901])
    got = log.replayed(retain=600)
    assert got["cn=b", 0] == (True, 3, {"x": ["1", "2", "3"]}) and got["cn=a", 0] == (True, 1, {"x": ["new"]})


@pytest.mark.parametrize("n", [1, 9])
def test_long_chains_of_renames(spark, n):
    rows = [(2 * k, [f"dc=x", f"ou={k}"], f"ou={k + 1}") for k in range(n)] + [(2 * k + 1, ["dc=x", f"ou={k + 1}", "uid=1"], None) for k in range(n)] + [(2 * n + 1, ["dc=x", "ou=0", "uid=1"], None)]
    df = spark.createDataFrame([(s, p, r) for s, p, r in rows], "seq bigint, path array<string>, renamed string")
    found, renames = P.resolve(df, spark.createDataFrame([], P.RENAMES))
    ids = {r["seq"]: r["ids"] for r in found.collect()}
    assert {r["node"] for r in renames.collect()} == {"ou=0"} and renames.count() == n
    assert all(ids[2 * k + 1] == ["dc=x", "ou=0", "uid=1"] for k in range(n)) and ids[2 * n + 1] == ["dc=x", "ou=0\t0", "uid=1"]
    assert P.resolve(df.where("false"), renames)[0].count() == 0
