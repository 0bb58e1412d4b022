"""Queries on bind rules and on who may do what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import bind_rules as B
from dirlake.operators import access
from dirlake.plans import tree
from dirlake.plans.compat_queries import cases
from dirlake.plans.queries import query


def _shown(x: Column) -> Column:
    p = B.parse(x)
    step = lambda s: F.when(s["op"].isNotNull(), s["op"]).otherwise(F.concat(s["key"], F.when(s["negated"], "!=").otherwise("="), F.array_join(s["values"], "|")))
    return F.coalesce(F.array_join(F.transform(p["steps"], step), " "), F.concat(F.lit("error: "), p["error"]))


cases(
    "bind_rule_postfix",
    [
        ('userdn="ldap:///self"', "userdn=self"), ('userdn = "ldap:///cn=@,dc=x || ldap:///anyone" and groupdn != "ldap:///cn=g"', "userdn=cn=@,dc=x|anyone groupdn!=cn=g and"),
        ('ip="1.*" or dns="@" and not (userdn="ldap:///all" or ssf="128") ', "ip=1.* dns=@ userdn=all ssf=128 or not and or"), ('((ip="(a or b)"))', "ip=(a or b)"), ('not not (ip="@")', "ip=@ not not"),
        ('(ip="@"', "error: bracket is not closed"), ('ip="a")', "error: bracket without opening at 6"), ('ip="a" ip="b"', "error: unexpected at 7: ip=\"b\""), ("", "error: empty"), ('ip="a" and', "error: ends early"), ("ip ~ 5", "error: unreadable at 0: ip ~ 5"), (None, None),
    ],
    _shown,
)
_RULE = '(ip="0" or ip="1") and not (ip="2" and ip!="3") or not ip="4"'


@query("""SELECT c_custkey, ((c_custkey % 2 = 1 OR c_custkey // 2 % 2 = 1) AND NOT (c_custkey // 4 % 2 = 1 AND NOT c_custkey // 8 % 2 = 1)) OR NOT c_custkey // 16 % 2 = 1 AS holds FROM customer""")
def bind_rule_truth(spark: SparkSession, sf: str) -> DataFrame:
    """An expression over all truths of its five terms, which are the last bits of a number."""
    steps = B.parse(F.concat(F.lit(_RULE), F.lit("")))["steps"]
    c = tree.table(spark, sf, "customer").select("c_custkey", steps.alias("steps"))
    bit = lambda s: F.shiftright(F.col("c_custkey").cast("int"), 0).bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(5))), F.get(s["values"], F.lit(0)).cast("int") + 1)) != 0
    hits = F.filter(F.transform("steps", lambda s, i: F.when(s["op"].isNull() & bit(s), i)), lambda i: i.isNotNull())
    return c.select("c_custkey", B.holds(F.col("steps"), hits).alias("holds"))


_MACROS = [
    ("($dn),dc=x => cn=u,ou=@,dc=x", "cn=u,ou=@"), ("ou=g,($dn),dc=x => cn=u,ou=g,ou=@,ou=h,dc=x", "ou=@,ou=h"), ("ou=g,($dn),dc=x => cn=u,ou=@,dc=x", None), ("($dn),dc=x => dc=x", None), ("ou=@,dc=x => ou=@,dc=x", None), ("($dn),dc=x => cn=u,dc=y", None),
]
cases("aci_macro_target", _MACROS, lambda x: B.captured(F.substring_index(x, " => ", 1), F.substring_index(x, " => ", -1)))
cases(
    "aci_macro_values",
    [("cn=a,($dn),dc=x => ou=@,ou=h", "cn=a,ou=@,ou=h,dc=x"), ("cn=a,[$dn],dc=x => ou=@,ou=h", "cn=a,ou=@,ou=h,dc=x;cn=a,ou=h,dc=x"), ("cn=@ => ou=h", "cn=@"), ("cn=a,[$dn] => ", ""), ("($dn) => ", "")],
    lambda x: F.array_join(B.filled(F.substring_index(x, " => ", 1), F.nullif(F.substring_index(x, " => ", -1), F.lit(""))), ";"),
)


def _group(name: str) -> str:
    return f'groupdn="ldap:///cn={name},ou=groups,dc=example,dc=com"'


#: The instruction of a nation's unit, by its number; the last one cannot be read.
_ACIS = (
    f'(version 3.0; acl "either"; allow (read) ({_group("building")} or {_group("vip")}) and not {_group("odd")};)',
    f'(version 3.0; acl "most"; allow (read, write) userdn="ldap:///all"; deny (read) {_group("odd")} and ({_group("vip")} or {_group("building")});)',
    '(version 3.0; acl "managers"; allow (all) userattr="manager#USERDN";)',
    '(target="ldap:///($dn),dc=example,dc=com")(version 3.0; acl "staff"; allow (read, delete) groupdn="ldap:///cn=staff,[$dn],dc=example,dc=com";)',
    f'(version 3.0; acl "others"; allow (read) not ({_group("vip")} or ({_group("odd")} and {_group("building")}));)',
    '(version 3.0; acl "broken"; allow (read) (userdn="ldap:///anyone";)',
)


@query("""
WITH u AS (SELECT c_custkey, n_nationkey % 6 AS k, c_acctbal > 5000 AS vip, c_custkey % 2 = 1 AS odd, c_mktsegment = 'BUILDING' AS building, c_custkey % 10 = 0 AS manager, c_custkey % 3 = 0 OR c_custkey % 7 = 0 AS staff,
    (['write', 'delete', 'read', 'read'])[CAST(c_custkey % 4 + 1 AS INTEGER)] AS p FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT *, CASE WHEN p = 'write' THEN 'nowrite' WHEN k = 1 AND p = 'read' AND odd AND (vip OR building) THEN 'most' END AS deny,
    CASE WHEN k = 0 AND p = 'read' AND (building OR vip) AND NOT odd THEN 'either' WHEN k = 1 AND p <> 'delete' THEN 'most' WHEN k = 2 AND manager THEN 'managers' WHEN k = 3 AND p <> 'write' AND staff THEN 'staff' WHEN k = 4 AND p = 'read' AND NOT (vip OR (odd AND building)) THEN 'others' END AS allow FROM u)
SELECT c_custkey AS request_id, deny IS NULL AND allow IS NOT NULL AS granted, coalesce(deny, allow) AS decided_by FROM r""")
def access_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer asks for something on the unit of their nation; rules hold at the unit and at the root."""
    n = tree.nations(spark, sf)
    c = tree.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    user = F.concat(F.lit("CN="), "c_name", F.lit(", "), "unit")
    p = F.element_at(F.array(*map(F.lit, ("write", "delete", "read", "read"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    requests = c.select(F.col("c_custkey").alias("request_id"), user.alias("user"), F.col("unit").alias("entry"), p.alias("permission"))
    own = n.select(F.col("unit").alias("dn"), F.element_at(F.array(*map(F.lit, _ACIS)), (F.col("n_nationkey") % 6 + 1).cast("int")).alias("aci"))
    top = spark.range(1).select(F.lit(tree.BASE).alias("dn"), F.explode(F.array(F.lit('(version 3.0; acl "nowrite"; deny (write) userdn="ldap:///anyone";)'), F.lit(f'(version 3.0; acl "vips"; allow (write) {_group("vip")};)'))).alias("aci"))
    name = lambda x: F.concat(F.lit("cn="), x, F.lit(",ou=groups,dc=example,dc=com"))
    staff = lambda unit: F.concat(F.lit("cn=staff,"), unit)
    groups = F.array(
        name(F.lower("c_mktsegment")), F.when(F.col("c_acctbal") > 5000, name(F.lit("VIP"))), F.when(F.col("c_custkey") % 2 == 1, name(F.lit("odd"))), F.when(F.col("c_custkey") % 7 == 0, staff(F.col("unit"))),
        F.when(F.col("c_custkey") % 3 == 0, staff(F.concat(F.lit("ou="), "r_name", F.lit("," + tree.BASE)))),
    )
    members = c.select(F.explode(groups).alias("group"), user.alias("member")).where("group is not null")
    managers = c.where("c_custkey % 10 = 0").select(F.col("unit").alias("entry"), F.lit("Manager").alias("attr"), user.alias("value"))
    return access.decide(requests, access.clauses(own.unionByName(top)), members, managers)
