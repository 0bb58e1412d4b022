import random

from pyspark.sql import functions as F

from dirlake.model import ATTRS
from dirlake.operators import changes as X
from dirlake.operators import references as R
from dirlake.sources import ldif


def attrs_of(rng):
    out = []
    for name in rng.sample(["a", "A", "b", "c", "d"], rng.randint(0, 4)):
        values = [rng.choice([("1", "plain", None), ("2", "plain", None), ("3", "plain", None), ("x", "base64", "eA=="), ("x", "base64", "eQ=="), (None, "plain", None)]) for _ in range(rng.randint(0, 5))]
        out.append((name, values))
    return out


def plain(attrs):
    """name: values as a multiset."""
    held: dict = {}
    for n, vs in attrs or []:
        held.setdefault(n.lower(), []).extend((v[0] or "", v[2]) for v in vs)
    return {n: sorted(v, key=str) for n, v in held.items() if v}


def test_records_of_a_difference_are_right_and_small(spark):
    rng = random.Random(11)
    rows = [(k, attrs_of(rng), attrs_of(rng) if rng.random() < 0.8 else None) for k in range(300)]
    df = spark.createDataFrame(rows, f"k int, a {ATTRS}, b {ATTRS}").withColumn("ops", X.operations(F.col("a"), F.col("b")))
    moved = {r["k"]: r["ops"] for r in df.select("k", X.operations(F.col("a"), F.col("b"), ordered=True).alias("ops")).collect()}
    got = df.select("k", "ops", X.applied(F.col("a"), F.col("ops")).alias("done"), X.operations(F.col("b"), F.col("b")).alias("same")).collect()
    for r, (_, a, b) in zip(sorted(got, key=lambda r: r["k"]), rows, strict=True):
        x, y = plain(a), plain(b)
        done = plain([(n, [tuple(v) for v in vs]) for n, vs in r["done"]])
        assert done == y and r["same"] == []
        assert {o["attr"].lower() for o in r["ops"]} == {n for n in {*x, *y} if x.get(n) != y.get(n)}
        for n in {*x, *y}:
            ops = [o for o in r["ops"] if o["attr"].lower() == n]
            named = sum(len(o["values"]) for o in ops)
            assert named <= len(y.get(n, [])) and len(ops) <= 2
        assert {o["attr"].lower() for o in moved[r["k"]]} >= {o["attr"].lower() for o in r["ops"]}


def test_order_counts_only_if_asked(spark):
    v = lambda *xs: [("a", [(x, "plain", None) for x in xs])]
    df = spark.createDataFrame([(v("1", "2"), v("2", "1"))], f"a {ATTRS}, b {ATTRS}")
    r = df.select(X.operations(F.col("a"), F.col("b")).alias("x"), X.operations(F.col("a"), F.col("b"), True).alias("y")).first()
    assert r["x"] == [] and [(o["op"], [w["value"] for w in o["values"]]) for o in r["y"]] == [("replace", ["2", "1"])]


def test_difference_through_text(spark):
    parse = lambda text: ldif.parse_text(spark.createDataFrame([(text,)], "text string"))
    a = parse("dn: ou=a,dc=x\nou: a\n\ndn: cn=b,ou=a,dc=x\ncn: b\nphoto:: /9j/\n\ndn: cn=gone,ou=a,dc=x\ncn: gone\n\ndn: ou=gone2,dc=x\nou: g\n\ndn: cn=x,ou=gone2,dc=x\ncn: x")
    b = parse("dn: OU=A, dc=x\nou: a\n\ndn: cn=b,ou=a,dc=x\ncn: b\ncn: bb\nphoto:: /9j/4AAB\n\ndn: cn=n,ou=new,dc=x\ncn: n\n\ndn: ou=new,dc=x\nou: new")
    records = X.change_records(a, b)
    order = [r["dn"] for r in records.orderBy("place", "dn").collect()]
    assert order == ["ou=new,dc=x", "cn=n,ou=new,dc=x", "cn=b,ou=a,dc=x", "cn=gone,ou=a,dc=x", "cn=x,ou=gone2,dc=x", "ou=gone2,dc=x"]
    again = ldif.parse(ldif.written(records).select(F.col("ldif").alias("record")))
    done = X.apply(a, again)
    shown = lambda df: sorted((X_key, sorted((x["name"].lower(), sorted((v["value"], v["raw"] or "") for v in x["values"])) for x in attrs)) for X_key, attrs in df.select(X.key_of(F.col("dn")), "attrs").collect())
    assert shown(done) == shown(b) and X.change_records(b, b).count() == 0 and X.change_records(a.limit(0), b.limit(0)).count() == 0


def test_closure_of_nested_groups_with_cycles(spark):
    rng = random.Random(6)
    edges = {(f"g{rng.randint(0, 14)}", rng.choice(["g", "u"]) + str(rng.randint(0, 14))) for _ in range(40)} | {("g1", "g1"), ("c1", "c2"), ("c2", "c1"), ("hub", "g0")} | {("hub", f"u{k}") for k in range(500)}
    df = spark.createDataFrame([*edges, *list(edges)[:3], (None, "x"), ("x", None)], "group string, member string")
    want = {}
    for g in {g for g, _ in edges}:
        level, depth, seen = {g}, 0, {}
        while level:
            depth += 1
            level = {m for a, m in edges if a in level} - set(seen)
            seen.update(dict.fromkeys(level, depth))
        want.update({(g, m): d for m, d in seen.items()})
    assert {(r["group"], r["member"]): r["depth"] for r in R.closure(df).collect()} == want
    assert R.closure(df.where("false")).count() == 0


def test_references(spark):
    text = "dn: cn=g,dc=x\nmember: CN=u, dc=x\nmember: cn=none,dc=x\nMember;range=0: not a name\nmanager:\nseeAlso: cn=g,dc=x\ndescription: cn=none2,dc=x\n\ndn: cn=u,dc=x\ncn: u"
    e = ldif.parse_text(spark.createDataFrame([(text,)], "text string"))
    assert sorted((r["attribute"], r["target"]) for r in R.references(e).collect()) == [("Member;range=0", "not a name"), ("member", "cn=none,dc=x"), ("member", "cn=u,dc=x"), ("seeAlso", "cn=g,dc=x")]
    assert sorted(r["target"] for r in R.dangling(e).collect()) == ["cn=none,dc=x", "not a name"]
    assert sorted(tuple(r) for r in R.memberships(e, ["member"]).collect()) == [("cn=g,dc=x", "cn=none,dc=x"), ("cn=g,dc=x", "cn=u,dc=x"), ("cn=g,dc=x", "not a name")]
