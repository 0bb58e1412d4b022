"""Queries on differences as change records, on references, and on nested groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import attrs as A
from dirlake.model import ATTRS
from dirlake.operators import changes as X
from dirlake.operators import references as R
from dirlake.plans import tree
from dirlake.plans.queries import _TREE, query
from dirlake.sources import ldif


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers before and after: by their number some come, some go, and of the others values, attributes and the spelling of names change."""
    c = tree.customers(spark, sf).select("record_no", "dn", F.element_at(F.split("dn", ",|="), 2).alias("name"))
    k = F.col("record_no") % 10
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    mails = [text(F.col("name"), f"@{d}") for d in "abcde"]
    old = A.entry_attrs(A.attr("cn", F.col("name")), A.attr("mail", *mails[:4]), A.attr("title", F.when(k.isin(3, 4), F.lit("old"))), A.attr("l", F.lit("x"), F.lit("y")))
    new = A.entry_attrs(
        A.attr("CN", F.col("name")), A.attr_of_array("mail", F.when(k == 2, F.array(*mails[:3], mails[4])).when(k == 3, F.array(mails[4])).when(k == 4, F.array(*mails[::-1])).otherwise(F.array(*mails[:4]))),
        A.attr("title", F.when(k == 4, F.lit("new")).when(k == 5, F.lit("first"))), A.attr_of_array("l", F.when(k == 6, F.array(F.lit("y"), F.lit("x"))).when(k == 7, F.array(F.lit("x"), F.lit("y"), F.lit("z"))).otherwise(F.array(F.lit("x"), F.lit("y")))),
    )
    before = c.where(k != 0).select("record_no", "dn", old.cast(ATTRS).alias("attrs"))
    after = c.where(k != 1).select("record_no", F.when(k == 8, F.upper("dn")).otherwise(F.col("dn")).alias("dn"), new.cast(ATTRS).alias("attrs"))
    return before, after


@query(_TREE + """SELECT dn, (['dn: ' || dn || chr(10) || 'changetype: add' || chr(10) || 'CN: ' || c_name || chr(10) || 'mail: ' || c_name || '@a' || chr(10) || 'mail: ' || c_name || '@b' || chr(10) || 'mail: ' || c_name || '@c' || chr(10) || 'mail: ' || c_name || '@d' || chr(10) || 'l: x' || chr(10) || 'l: y',
    'dn: ' || dn || chr(10) || 'changetype: delete',
    'dn: ' || dn || chr(10) || 'changetype: modify' || chr(10) || 'delete: mail' || chr(10) || 'mail: ' || c_name || '@d' || chr(10) || '-' || chr(10) || 'add: mail' || chr(10) || 'mail: ' || c_name || '@e' || chr(10) || '-',
    'dn: ' || dn || chr(10) || 'changetype: modify' || chr(10) || 'replace: mail' || chr(10) || 'mail: ' || c_name || '@e' || chr(10) || '-' || chr(10) || 'delete: title' || chr(10) || '-',
    'dn: ' || dn || chr(10) || 'changetype: modify' || chr(10) || 'add: mail' || chr(10) || 'mail: ' || c_name || '@e' || chr(10) || '-' || chr(10) || 'replace: title' || chr(10) || 'title: new' || chr(10) || '-',
    'dn: ' || dn || chr(10) || 'changetype: modify' || chr(10) || 'add: title' || chr(10) || 'title: first' || chr(10) || '-',
    NULL, 'dn: ' || dn || chr(10) || 'changetype: modify' || chr(10) || 'add: l' || chr(10) || 'l: z' || chr(10) || '-'])[CAST(c_custkey % 10 + 1 AS INTEGER)] AS ldif FROM c WHERE c_custkey % 10 NOT IN (6, 8, 9)""")
def difference_records(spark: SparkSession, sf: str) -> DataFrame:
    return ldif.written(X.change_records(*_states(spark, sf)), width=1 << 20).select("dn", "ldif")


@query(_TREE + """SELECT c_custkey, CASE WHEN c_custkey % 10 = 8 THEN upper(dn) ELSE dn END AS dn_after, TRUE AS same FROM c WHERE c_custkey % 10 <> 1""")
def difference_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The records applied to the first state give the second, whatever the order of values and the spelling of names."""
    before, after = _states(spark, sf)
    done = X.apply(before, X.change_records(before, after))
    plain = lambda c: F.to_json(F.sort_array(F.transform(c, lambda a: F.struct(F.lower(a["name"]).alias("n"), F.sort_array(a["values"]["value"]).alias("v")))))
    a = done.select(X.key_of(F.col("dn")).alias("key"), plain(F.col("attrs")).alias("got"))
    b = after.select("record_no", F.col("dn").alias("dn_after"), X.key_of(F.col("dn")).alias("key"), plain(F.col("attrs")).alias("want"))
    return a.join(b, "key", "full_outer").select(F.col("record_no").alias("c_custkey"), "dn_after", F.col("got").eqNullSafe(F.col("want")).alias("same"))


def _teams(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as groups: each holds those of twice its number and one more, the eighth of each eight closes a ring of three, and some hold people who are there, and who are not."""
    s = tree.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda k: F.concat(F.lit("cn=team "), k.cast("string"), F.lit(",ou=teams,dc=x"))
    k = F.col("k")
    ring = F.when(k % 8 == 5, name(k + 1)).when(k % 8 == 6, name(k + 1)).when(k % 8 == 7, F.upper(name(k - 2)))
    person = F.when(k % 3 == 0, F.concat(F.lit("uid="), k.cast("string"), F.lit(", ou=people,dc=x")))
    groups = s.select(name(k).alias("dn"), A.entry_attrs(A.attr("cn", k.cast("string")), A.attr("member", name(2 * k), name(2 * k + 1), ring), A.attr("uniqueMember", person), A.attr("owner", F.when(k % 4 == 0, F.lit("cn=boss,dc=x")))).alias("attrs"))
    people = s.where("k % 6 = 0").select(F.concat(F.lit("UID="), k.cast("string"), F.lit(",ou=people,dc=x")).alias("dn"), A.entry_attrs(A.attr("uid", k.cast("string"))).alias("attrs"))
    return groups.unionByName(people)


_EDGES = """
WITH RECURSIVE s AS (SELECT s_suppkey AS k FROM supplier),
e AS (SELECT k, 'member' AS attribute, 'cn=team ' || 2 * k || ',ou=teams,dc=x' AS target, 2 * k AS t FROM s UNION ALL SELECT k, 'member', 'cn=team ' || (2 * k + 1) || ',ou=teams,dc=x', 2 * k + 1 FROM s
    UNION ALL SELECT k, 'member', 'cn=team ' || m || ',ou=teams,dc=x', m FROM (SELECT k, CASE WHEN k % 8 IN (5, 6) THEN k + 1 ELSE k - 2 END AS m FROM s WHERE k % 8 IN (5, 6, 7))
    UNION ALL SELECT k, 'uniqueMember', 'uid=' || k || ',ou=people,dc=x', NULL FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'owner', 'cn=boss,dc=x', NULL FROM s WHERE k % 4 = 0),
"""


@query(_EDGES + """n AS (SELECT 'cn=team ' || k || ',ou=teams,dc=x' AS target FROM s UNION SELECT 'uid=' || k || ',ou=people,dc=x' FROM s WHERE k % 6 = 0)
SELECT 'cn=team ' || k || ',ou=teams,dc=x' AS key, attribute, target FROM e WHERE target NOT IN (SELECT target FROM n)""")
def references_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return R.dangling(_teams(spark, sf)).select("key", "attribute", "target")


@query(_EDGES + """p AS (SELECT k AS top, target, t FROM e WHERE attribute <> 'owner' UNION SELECT p.top, e.target, e.t FROM p JOIN e ON p.t = e.k AND e.attribute <> 'owner')
SELECT 'cn=team ' || top || ',ou=teams,dc=x' AS holder, target AS member FROM p""")
def group_closure(spark: SparkSession, sf: str) -> DataFrame:
    return R.closure(R.memberships(_teams(spark, sf))).select(F.col("group").alias("holder"), "member")
