import itertools
import random

from pyspark.sql import functions as F

from dirlake.functions import bind_rules as B
from dirlake.operators import access


def expression(rng, depth, terms):
    """(text, function of the truths of its terms)."""
    kind = rng.choice(["term", "not", "and", "or"]) if depth else "term"
    if kind == "term":
        k, negated = len(terms), rng.random() < 0.3
        terms.append(negated)
        return f'ip{"!=" if negated else " = "}"{k}"', lambda t: t[k] != negated
    if kind == "not":
        x, f = expression(rng, depth - 1, terms)
        return f"not ({x})", lambda t: not f(t)
    (x, f), (y, g) = expression(rng, depth - 1, terms), expression(rng, depth - 1, terms)
    return (f"({x}) AND ({y})", lambda t: f(t) and g(t)) if kind == "and" else (f"({x} or {y})", lambda t: f(t) or g(t))


def test_expressions_over_all_truths(spark):
    rng = random.Random(9)
    rows = []
    for k in range(25):
        terms: list = []
        text, f = expression(rng, 3, terms)
        for truths in itertools.islice(itertools.product([False, True], repeat=len(terms)), 16):
            rows.append((k, text, [i for i, x in enumerate(truths) if x], bool(f(truths))))
    df = spark.createDataFrame(rows, "k int, rule string, truths array<int>, want boolean").withColumn("steps", B.parse(F.col("rule"))["steps"])
    # positions count the terms and operators of the postfix form
    at = F.filter(F.transform("steps", lambda s, i: F.when(s["op"].isNull() & F.array_contains("truths", F.get(s["values"], F.lit(0)).cast("int")), i)), lambda i: i.isNotNull())
    bad = [r for r in df.withColumn("got", B.holds(F.col("steps"), at)).collect() if r["got"] != r["want"]]
    assert len(rows) > 100 and not bad


def test_precedence_without_brackets():
    shown = lambda text: [s["op"] or s["values"][0] for s in B.postfix(text)[0]]
    assert shown('ip="1" or ip="2" and not ip="3" or ip="4"') == ["1", "2", "3", "not", "and", "or", "4", "or"]
    assert shown('not ip="1" and ip="2"') == ["1", "not", "2", "and"] and shown('ip="1" and (ip="2" or ip="3")') == ["1", "2", "3", "or", "and"]


RULES = [
    ("dc=x", '(version 3.0; acl "self"; allow (read, write) userdn="ldap:///self";)'),
    ("ou=a,dc=x", '(targetscope="onelevel")(version 3.0; acl "one"; allow (read) userdn="ldap:///cn=*,ou=b,dc=x" and groupdn!="ldap:///cn=out";)'),
    ("ou=a,dc=x", '(target="ldap:///cn=s_1*,ou=a,dc=x")(version 3.0; acl "like"; allow (search) userdn="ldap:///anyone";)'),
    ("dc=x", '(target="ldap:///ou=deep,($dn),dc=x")(version 3.0; acl "macro"; allow (write) groupdn="ldap:///cn=g,($dn),dc=x || ldap:///cn=h,[$dn],dc=x";)'),
    ("dc=x", '(version 3.0; acl "owner"; allow (all) userattr="owner#USERDN" or userattr="team#GROUPDN"; deny (delete) userdn="ldap:///parent";)'),
    ("dc=x", None), ("dc=x", "no rule"), ("dc=x", '(version 3.0; acl "bad"; allow (all) userdn=;)'), ("dc=x", '(version 3.0; acl "known"; allow (compare) userdn="ldap:///all";)'),
]
CASES = [
    # user, entry, permission, granted, by
    ("CN=u, DC=X", "cn=u,dc=x", "Read", True, "self"), ("cn=u,dc=x", "cn=v,dc=x", "read", False, None), (None, "cn=u,dc=x", "read", False, None), ("cn=1,ou=b,dc=x", "cn=q,ou=a,dc=x", "read", True, "one"), ("cn=1,ou=b,dc=x", "ou=a,dc=x", "read", False, None),
    ("cn=1,ou=b,dc=x", "cn=r,cn=q,ou=a,dc=x", "read", False, None), ("cn=2,ou=b,dc=x", "cn=q,ou=a,dc=x", "read", False, None), ("", "cn=s_12,ou=a,dc=x", "search", True, "like"), ("", "cn=sx12,ou=a,dc=x", "search", False, None),
    ("cn=m,dc=x", "cn=q,ou=deep,ou=k,ou=l,dc=x", "write", True, "macro"), ("cn=n,dc=x", "ou=deep,ou=k,ou=l,dc=x", "write", True, "macro"), ("cn=n,dc=x", "ou=deep,ou=l,dc=x", "write", True, "macro"), ("cn=m,dc=x", "ou=deep,ou=l,dc=x", "write", False, None), ("cn=m,dc=x", "ou=deep,dc=x", "write", False, None),
    ("cn=o,dc=x", "cn=owned,dc=x", "delete", True, "owner"), ("cn=t,dc=x", "cn=owned,dc=x", "add", True, "owner"), ("cn=p,dc=x", "cn=c,cn=p,dc=x", "delete", False, "owner"), ("cn=p,dc=x", "cn=c,cn=p,dc=x", "compare", True, "known"), (None, "cn=c,dc=x", "compare", False, None), ("cn=o,dc=x", None, "add", False, None),
]


def test_decisions(spark):
    requests = spark.createDataFrame([(k, u, e, p) for k, (u, e, p, _, _) in enumerate(CASES)], "request_id int, user string, entry string, permission string")
    rules = access.clauses(spark.createDataFrame(RULES, "dn string, aci string"))
    members = spark.createDataFrame([("cn=out", "cn=2,ou=b,dc=x"), ("cn=g,ou=k,ou=l,dc=x", "cn=m,dc=x"), ("CN=h, ou=l,dc=x", "cn=n,dc=x"), ("cn=team,dc=x", "cn=t,dc=x"), ("cn=team,dc=x", "cn=t,dc=x"), (None, None)], "group string, member string")
    values = spark.createDataFrame([("cn=owned,dc=x", "Owner", "cn=o,dc=x"), ("cn=owned,dc=x", "team", "cn=team,dc=x"), ("cn=owned,dc=x", None, None)], "entry string, attr string, value string")
    got = {r["request_id"]: (r["granted"], r["decided_by"]) for r in access.decide(requests, rules, members, values).collect()}
    assert got == {k: (g, by) for k, (*_, g, by) in enumerate(CASES)}
    assert sorted(r["error"][:10] for r in rules.where("error is not null").collect()) == ["unreadable"]
    none = access.decide(requests, rules.where("false"), members.where("false")).collect()
    assert {(r["granted"], r["decided_by"]) for r in none} == {(False, None)} and len(none) == len(CASES)
    assert access.decide(requests.where("false"), rules, members, values).count() == 0
