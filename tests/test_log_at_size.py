import datetime as dt
import json

import pyarrow as pa
from pyspark.sql import functions as F

from dirlake.functions import dn as D
from dirlake.functions import records as R
from dirlake.sources import ldif
from dirlake.streaming import queries as Q
from dirlake.streaming import replay as P


def test_names_in_the_log_come_from_blocks_of_events(spark, tmp_path):
    # numbers with gaps over many blocks, renames far before the events that use them
    ids = sorted({0, 7, 8, 13, 14, 207, 513, 9_999, 10_000, 10_013, 20_007, 20_008, 55_513, 55_514, 99_999, 130_007, 250_013, 250_014, 250_207, 400_001, *range(70_000, 70_900)})
    rows = [(i, dt.datetime(2024, 1, 1), i * 7 % 13, ("view", "signup", "error")[i % 3], 1.0) for i in ids]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    log = Q._log(spark, str(tmp_path))
    # records come as texts, so that a part of them can be taken before they are parsed
    assert log.columns == ["seq", "ts", "record"]
    got = {r["seq"]: r["record"].split("\n")[0] for r in log.collect()}
    want = {}
    for i, _, user, _, _ in rows:
        unit, top = max((j for j, _, u, _, _ in rows if j % 200 == 7 and j < i and u % 5 == user % 5), default=""), max((j for j in ids if j % 500 == 13 and j < i), default="")
        above = f"ou=top{top and f'R{top}'},dc=x"
        below = f"ou=u{user % 5}{unit and f'R{unit}'},{above}"
        want[3 * i] = f"dn: UID={user}, {below}"
        want |= {3 * i + 1: f"dn: {below}"} if i % 200 == 7 else {}
        want |= {3 * i + 2: f"dn: {above}"} if i % 500 == 13 else {}
    assert got == want
    e = spark.createDataFrame([(i, "u1", i // Q._BLOCK) for i in range(0, 3_000_000, 100)], "event_id bigint, unit string, block bigint").withColumn("event_id", F.col("event_id") + 7)
    # what an event looks through does not grow with the log
    assert Q._names(e).agg(F.max(F.size("units"))).first()[0] == Q._BLOCK // 200


def test_records_of_an_entry_are_packed_and_applied_by_number(spark, tmp_path):
    far = P._NEAR * 3
    texts = ["dn: cn=a\nchangetype: add\nx: é\"\\\ny: 0", *["dn: cn=a\nchangetype: modify\nincrement: y\ny: 1\n-"] * 500, "dn: cn=a\nchangetype: modify\nadd: x\nx:\n-"]
    seqs = [1, *range(far, far + 500), far + 1000]
    log = ldif.parse(spark.createDataFrame([(s, None, t) for s, t in zip(seqs, texts, strict=True)], "seq bigint, ts timestamp, record string"))
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    entries, _ = P.replay(spark, P.records(stream, time="ts"), f"{tmp_path}/work")
    # two rows for Python, whatever the number of records
    assert [len(json.loads(r["records"])) for r in spark.read.parquet(f"{tmp_path}/work/records").orderBy(F.length("records")).collect()] == [1, 501]
    (e,) = entries.collect()
    assert (e["changes"], e["seq"], e["present"], {a["name"]: a["values"] for a in e["attrs"]}) == (502, far + 1000, True, {"x": ['é"\\', ""], "y": ["500"]})


def test_records_are_packed_by_time_where_late_ones_are_told_by_it(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "a"), (2, t, "a"), (3, t + dt.timedelta(0, 60), "a"), (4, None, "a"), (5, t, "b")]
    df = spark.createDataFrame([(s, x, k, "delete", []) for s, x, k in rows], f"seq bigint, time timestamp, key string, kind string, ops {P.OPS}")
    seqs = lambda by: sorted((r["key"], r["time"], sorted((x["seq"], x["time"]) for x in json.loads(r["records"]) if x["seq"] != 4)) for r in P.packed(df, by).where("time is not null").collect())
    u = 1_704_067_200_000_000
    assert seqs(True) == [("a", t, [(1, u), (2, u)]), ("a", t + dt.timedelta(0, 60), [(3, u + 60_000_000)]), ("b", t, [(5, u)])]
    assert seqs(False) == [("a", t + dt.timedelta(0, 60), [(1, u), (2, u), (3, u + 60_000_000)]), ("b", t, [(5, u)])]


def test_names_are_split_as_before_at_any_length(spark):
    odd = ["cn=a\\,b , O = x\\", "a\\\n,b=c", "\\", ",,", "no name", None, "a=\\\\,b=\\", "a=b\nc, d=\t", "\\\n"]
    df = spark.createDataFrame([(n,) for n in odd], "dn string")
    alternatives = F.filter(F.transform(F.regexp_extract_all("dn", F.lit(r"(?:\\.|[^,\\]|\\$)+"), F.lit(0)), D.strip), lambda p: p != "")
    assert [r[0] for r in df.select(D.split_dn(F.col("dn"))).collect()] == [r[0] for r in df.select(alternatives).collect()]
    assert [r[0] for r in df.select(D.norm_dn(F.col("dn"))).collect()] == ["cn=a\\,b,o=x\\", "b=c", None, None, None, None, "a=\\\\,b=\\", "a=b\nc,d=", None]
    long = "cn=" + "a\\," * 50_000
    assert spark.createDataFrame([(f"{long}, O=x",)], "dn string").select(D.norm_dn(F.col("dn"))).first()[0] == f"{long},o=x"


def test_paths_of_plain_and_escaped_names_are_alike(spark):
    names = ["UID=1, ou=A B ,dc=X", " cn = a = b ,, \t,no part, O=", "=x,DC=Y", "cn=a\\,b,O=x", "cn=a\\ ,o=x", "cn=ΑΣ,ou=İ", "cn=a\nb,\nou=c\t"]
    df = spark.createDataFrame([(n,) for n in names], "dn string")
    general = F.reverse(D.split_dn(F.lower(D.norm_dn(F.col("dn")))))
    assert [r[0] for r in df.select(P._path(F.col("dn"))).collect()] == [r[0] for r in df.select(general).collect()]


def test_only_odd_names_are_checked_one_by_one(monkeypatch):
    plain, odd = ["cn=a", " a-1= ,\tO=x=y", "cn=a\n,o=é "], ["", None, "cn", "1a=x", "cn=a,,o=x", "cn=a,", ",cn=a", "cn=a\\,b", "cn=a,b", "cn=\\", "a=b,c d=e", "a =b", "\\", "cn=a,2.5=x"]
    names = pa.array(plain + odd, pa.string())
    want, seen = [R.dn_error(n) for n in names.to_pylist()], []
    check = R.dn_error
    monkeypatch.setattr(R, "dn_error", lambda n: seen.append(n) or check(n))
    assert R._dn_errors(names).to_pylist() == want and seen == odd and R._dn_errors(pa.array([], pa.string())).to_pylist() == []
