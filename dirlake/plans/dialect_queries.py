"""Queries over entries of many dialects, each of which carries its own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import attrs as A, dn as N, schema4512 as S, validate as V
from dirlake.model import ATTRS
from dirlake.operators import by_dialect as B
from dirlake.operators import compat as C, entries as E
from dirlake.operators import more as M
from dirlake.plans import tree
from dirlake.plans.compat_queries import cases
from dirlake.plans.queries import query
from dirlake.sources import ldif

#: An attribute that tells each dialect, and the spelling under which the query asks for its rules.
_SIGNS = (("oid", "orclGUID", "Oracle_OID"), ("oud", "ds-sync-hist", "oud"), ("openldap2", "olcSuffix", "OpenLDAP"), ("ad", "objectGUID", " ActiveDirectory "), ("ds389", "nsUniqueId", "389DS"), ("novell", "nspmStatus", "edirectory"), ("ibm_tivoli", "ibm-entryUuid", "tivoli"), ("apache", "ads-id", "ApacheDS"))
_RULES = (
    'access to attr=(cn,sn) by group="cn=g@" (read,write)', '(targetattr="cn || sn")(version 3.0; acl "r@"; allow (read,search) userdn="ldap:///self";)', "{0}to attrs=cn by users write", None,
    '(targetattr="*")(version 3.0; acl "s@"; allow (all) groupdn="ldap:///cn=g@";)', "cn=x@#subtree#[RW]", 'access "read"', None,
)
_ACL = ("orclaci", "aci", "olcAccess", None, "aci", "ACL", "ibm-filterAclEntry", None)


def _pick(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), k + 1)


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as entries of eight dialects in turn: complete, without naming attribute, without object class, or with text that is not ASCII; every fifth is a unit, some bear an access rule."""
    c = tree.table(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 8).cast("int").alias("k"), (F.floor(F.col("c_custkey") / 8) % 4).cast("int").alias("v"))
    named = lambda name, value, when: F.when(when, F.struct(name.alias("name"), F.array(A.plain_value(value)).alias("values")))
    kind = F.when(F.col("c_custkey") % 5 == 0, "organizationalUnit").otherwise("person")
    rule = F.replace(_pick(_RULES, F.col("k")), F.lit("@"), F.col("c_custkey").cast("string"))
    attrs = F.array(
        named(F.lit("objectClass"), kind, F.col("v") != 2), named(F.lit("cn"), F.col("c_name"), F.col("v") != 1), named(_pick(tuple(s[1] for s in _SIGNS), F.col("k")), F.lit("x"), F.lit(True)),
        named(F.lit("description"), F.concat(F.lit("é"), F.col("c_name")), F.col("v") == 3), named(_pick(_ACL, F.col("k")), rule, rule.isNotNull() & (F.col("v") == 0)),
    )
    attrs = F.filter(attrs, lambda a: a.isNotNull()).cast(ATTRS)
    return c.select("c_custkey", F.concat(F.lit("cn="), "c_name", F.lit(",ou=p,dc=example,dc=com")).alias("dn"), attrs.alias("attrs"), _pick(tuple(s[2] for s in _SIGNS), F.col("k")).alias("spelling"))


_MIXED = """
WITH c AS (SELECT c_custkey, c_name, CAST(c_custkey % 8 AS INTEGER) AS k, CAST((c_custkey // 8) % 4 AS INTEGER) AS v FROM customer),
d AS (SELECT *, (['oid', 'oud', 'openldap2', 'ad', 'ds389', 'novell', 'ibm_tivoli', 'apache'])[k + 1] AS dialect FROM c)
"""
_FOUND = """concat_ws(';', CASE WHEN v = 3 AND dialect IN ('oid', 'oud', 'openldap2') THEN 'Server requires '';binary'' option for ''description''' END,
    CASE WHEN v = 1 AND dialect IN ('oid', 'oud', 'ad'{naming}) THEN 'Server requires naming attribute ''cn''' END,
    CASE WHEN v = 2 AND dialect NOT IN ('openldap2', 'apache') THEN 'Server requires objectClass attribute' END{more})"""


@query(
    _MIXED + f"""SELECT c_custkey, dialect, {_FOUND.format(naming="", more="")} AS violations,
    CASE WHEN dialect NOT IN ('oid', 'oud') OR v = 2 THEN CASE WHEN dialect = 'oid' AND v = 0 THEN 'acl' ELSE 'rejected' END WHEN c_custkey % 5 = 0 THEN 'hierarchy' WHEN dialect = 'oid' AND v = 0 THEN 'acl' WHEN dialect = 'oud' AND v = 0 THEN 'acl' ELSE 'users' END AS category,
    CASE WHEN dialect NOT IN ('oid', 'oud') OR v = 2 THEN 'No category match' END AS rejection_reason FROM d"""
)
def mixed_dialects(spark: SparkSession, sf: str) -> DataFrame:
    rules = B.rule_table(spark)
    e = B.categorize(B.with_rules(B.detect_entries(mixed(spark, sf).drop("spelling"), rules), rules))
    return e.select("c_custkey", "dialect", F.array_join(B.server_violations(F.col("dn"), F.col("attrs"), F.col("rules")), ";").alias("violations"), "category", "rejection_reason")


@query(
    _MIXED + "SELECT c_custkey, dialect, "
    + _FOUND.format(naming=", 'apache'", more=", CASE WHEN dialect = 'apache' AND v = 2 THEN 'Server requires objectClass attribute' END, CASE WHEN dialect = 'openldap2' AND v = 3 AND c_custkey % 5 <> 0 THEN 'Server forbids attribute ''description'' of class ''person''' END, CASE WHEN dialect = 'openldap2' AND v = 1 THEN 'Server requires attribute ''CN''' END")
    + " AS violations FROM d"
)
def injected_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that are added to two dialects at run time, for entries whose dialect is a name in any spelling."""
    more = spark.createDataFrame([("openldap2", [("forbids", "description", "person"), ("requires", "CN", None)], None), ("apache", None, ["naming", "objectclass"])], "dialect string, checks array<struct<rule: string, attribute: string, object_class: string>>, requires array<string>")
    names = [f.name for f in B.rule_table(spark).schema]
    rules = B.injected(B.rule_table(spark), B.rule_table(spark).limit(0).unionByName(more, allowMissingColumns=True).select(*names))
    e = B.with_rules(mixed(spark, sf), rules, "spelling")
    return e.select("c_custkey", B.resolved(F.col("spelling")).alias("dialect"), F.array_join(B.server_violations(F.col("dn"), F.col("attrs"), F.col("rules")), ";").alias("violations"))


@query(
    _MIXED + """SELECT c_custkey, dialect, (['orclaci', 'aci', 'olcAccess', NULL, 'aci', 'ACL', 'ibm-filterAclEntry', NULL])[k + 1] AS attribute,
    (['group', 'self', 'who', NULL, 'group', 'user', 'user', NULL])[k + 1] AS subject_type,
    (['cn=g' || c_custkey, 'self', 'users', NULL, 'cn=g' || c_custkey, 'subtree', '', NULL])[k + 1] AS subject,
    (['cn,sn', 'cn,sn', 'cn', NULL, '*', '', '', NULL])[k + 1] AS target_attrs,
    (['read,write', 'read,search', 'compare,search,read,write', NULL, 'all', 'read,write', 'read', NULL])[k + 1] AS permissions FROM d WHERE v = 0 AND k NOT IN (3, 7)"""
)
def acl_by_dialect(spark: SparkSession, sf: str) -> DataFrame:
    rules = B.rule_table(spark)
    e = B.with_rules(B.detect_entries(mixed(spark, sf), rules), rules)
    found = B.acl_entries(e).join(e.select("dn", "c_custkey"), "dn")
    return found.select("c_custkey", "dialect", "attribute", "parsed.subject_type", "parsed.subject", F.array_join("parsed.target_attrs", ",").alias("target_attrs"), F.array_join("parsed.permissions", ",").alias("permissions"))


@query(
    _MIXED + """, f AS (SELECT CASE WHEN c_custkey % 7 = 3 THEN 'generic' ELSE dialect END AS dialect, count(*) AS entries FROM d GROUP BY 1)
    SELECT dialect, entries, kind, dialect <> 'generic' AND (kind <> 'acl' OR dialect <> 'apache') AS supported FROM f, (SELECT unnest(['attribute', 'objectclass', 'acl', 'entry']) AS kind)"""
)
def supported_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """What can be converted of the dialects that a table's entries have; some are told to be of none."""
    e = B.detect_entries(mixed(spark, sf), B.rule_table(spark))
    return C.supported_in(e.withColumn("dialect", F.when(F.col("c_custkey") % 7 == 3, "generic").otherwise(F.col("dialect"))))


@query(
    _MIXED + """SELECT dialect, count(*) AS entries, min(c_custkey) FILTER (c_custkey % 3 <> 0) AS first_seen,
    array_to_string(list_sort(list_filter([CASE WHEN count(*) FILTER (v = 1) > 0 THEN 'naming=' || count(*) FILTER (v = 1) END, CASE WHEN count(*) FILTER (v = 2) > 0 THEN 'class=' || count(*) FILTER (v = 2) END], lambda x: x IS NOT NULL)), ',') AS reasons FROM d GROUP BY 1"""
)
def statistics_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of many parts as those of a whole: counts and maps of reasons are added, and the first value that is there stays."""
    e = B.detect_entries(mixed(spark, sf), B.rule_table(spark))
    v = F.floor(F.col("c_custkey") / 8) % 4
    seen = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey"))
    one = F.when(v == 1, F.create_map(F.lit("naming"), F.lit(1).cast("bigint"))).when(v == 2, F.create_map(F.lit("class"), F.lit(1).cast("bigint")))
    parts = e.select("dialect", F.lit(1).alias("entries"), seen.alias("first_seen"), one.alias("reasons"), "c_custkey")
    whole = M.merge_statistics(parts, "dialect", ["entries"], firsts=["first_seen"], maps=["reasons"], order="c_custkey")
    shown = F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return whole.select("dialect", "entries", "first_seen", F.array_join(F.array_sort(shown), ",").alias("reasons"))


@query(_MIXED + "SELECT dialect AS server_type, count(*) AS n FROM d GROUP BY 1")
def server_types(spark: SparkSession, sf: str) -> DataFrame:
    return M.server_types(B.detect_entries(mixed(spark, sf), B.rule_table(spark), "server_type"))


@query("SELECT c_custkey, 'ds389' AS server_type, c_custkey % 3 = 1 OR c_custkey % 3 = 2 AS is_config_entry FROM customer")
def tagged_entries(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("c_custkey") % 3 + 1).cast("int")
    dn = F.concat(F.lit("cn="), "c_name", F.element_at(F.array(F.lit(",dc=x"), F.lit(",CN=Monitor"), F.lit(",cn=changelog,dc=x")), k))
    return M.tag(tree.table(spark, sf, "customer").select("c_custkey", dn.alias("dn")), "ds389").drop("dn")


def _spelled(x: Column) -> Column:
    """Attributes from text: `name=value,name=value`."""
    return F.transform(F.split(x, ","), lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.array(A.plain_value(F.substring_index(p, "=", -1))).alias("values"))).cast(ATTRS)


cases("attrs_exact", [("Cn=@,cn=b,CN=c", "b"), ("CN=@", ""), ("cn=@", "@"), ("cn=@,cn=x", "@")], lambda x: F.array_join(A.values_exact(_spelled(x), "cn"), "|"))
cases("attrs_merged", [("Cn=@,sn=s,cN=b", "Cn=@+b|sn=s"), ("OBJECTCLASS=top,cn=@,objectClass=person", "objectClass=top+person|cn=@"), ("a=@", "a=@")], lambda x: F.array_join(F.transform(A.merge_names(_spelled(x)), lambda a: F.concat(a["name"], F.lit("="), F.array_join(a["values"]["value"], "+"))), "|"))
cases("attrs_unconverted", [('{"a": "@", "b": ["x", 1, true], "c": 2, "d": {"e": 1}}', 'a=@|b=x+1+true|c=2|d={"e":1}'), ("[1]", ""), (None, ""), ("{}", "")], lambda x: F.array_join(F.transform(A.unconverted(x), lambda a: F.concat(a["name"], F.lit("="), F.array_join(a["values"]["value"], "+"))), "|"))
cases(
    "oid_checks",
    [("( 2.16.840.1.113894.1 NAME '@' )", "2.16.840.1.113894.1 true true"), ("( 1.2.3 NAME '@' )", "1.2.3 true false"), ("( 1..2 NAME '@' )", "1..2 false false"), ("NAME '@'", "none false false"), ("(2.16.840.1.113894 )", "2.16.840.1.113894 true true")],
    lambda x: F.concat_ws(" ", F.coalesce(S.oid_of(x), F.lit("none")), V.numeric_oid_ok(S.oid_of(x)).cast("string"), F.coalesce(S.oid_of(x).rlike(r"^2\.16\.840\.1\.113894(\.|$)"), F.lit(False)).cast("string")),
)
cases(
    "entry_created",
    [("cn=@,dc=x", "cn=@,dc=x top+person ok"), ("@", "none  invalid DN: @"), ("", "none  invalid DN: "), (None, "none  invalid DN: ")],
    lambda x: F.concat_ws(" ", *(F.coalesce(F.get(F.transform(F.array(E.create(x, A.entry_attrs(A.attr("cn", F.lit("a"))), ["top", "person"])), f), F.lit(0)), F.lit(o)) for f, o in ((lambda e: e["dn"], "none"), (lambda e: F.array_join(A.object_classes(e["attrs"]), "+"), "none"), (lambda e: e["error"], "ok")))),
)


@query("SELECT c_custkey, '1.' || c_custkey % 11 || '.' || c_custkey AS oid, row_number() OVER (ORDER BY [1, c_custkey % 11, c_custkey]) AS place FROM customer")
def definitions_by_number(spark: SparkSession, sf: str) -> DataFrame:
    """The places of definitions by the numbers of their OIDs, not by their text."""
    k = F.col("c_custkey")
    oid = F.concat(F.lit("1."), (k % 11).cast("string"), F.lit("."), k.cast("string"))
    d = tree.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("( "), oid, F.lit(" NAME 'x' )")).alias("definition"))
    return E.ranked(d, M.oid_numbers(F.col("definition"))).select("c_custkey", S.oid_of(F.col("definition")).alias("oid"), "place")


@query("SELECT c_custkey * 2 + i AS n, 'cn=' || c_name || ',dc=x' AS canonical FROM customer, (VALUES (0), (1)) v(i)")
def dn_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The first spelling of each name, for all of its spellings."""
    c = tree.table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("n"), F.concat(F.lit("cn="), "c_name", F.lit(",dc=x")).alias("dn"))
    both = c.unionByName(c.select((F.col("n") + 1).alias("n"), F.concat(F.lit(" "), F.upper("dn")).alias("dn")))
    return N.canonical(both, order="n").select("n", F.col("canonical_dn").alias("canonical"))


@query(
    _MIXED + """, e AS (SELECT v, dialect, unnest([CASE WHEN v = 3 AND dialect IN ('oid', 'oud', 'openldap2') THEN 'Server requires '';binary'' option for ''description''' END, CASE WHEN v = 1 AND dialect IN ('oid', 'oud', 'ad') THEN 'Server requires naming attribute ''cn''' END, CASE WHEN v = 2 AND dialect NOT IN ('openldap2', 'apache') THEN 'Server requires objectClass attribute' END]) AS error FROM d)
    SELECT (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM e WHERE error IS NOT NULL) AS invalid, (SELECT string_agg(DISTINCT error, ';' ORDER BY error) FROM e) AS errors"""
)
def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up's errors themselves: distinct and in the order of their text."""
    rules = B.rule_table(spark)
    e = B.with_rules(B.detect_entries(mixed(spark, sf), rules), rules).select(B.server_violations(F.col("dn"), F.col("attrs"), F.col("rules")).alias("violations"))
    return V.roll_up(e).select("total", "invalid", F.array_join("errors", ";").alias("errors"))


@query("""SELECT c_custkey, '# [REJECTION] No category match' || chr(10) || '# [REMOVED] l: x' || chr(10) || '# [TRANSFORMED] cn: a -> ' || c_name || chr(10) || '# ' || repeat('=', 70) || chr(10) || '# ORIGINAL Entry (alternative format) (commented)' || chr(10) || '# ' || repeat('=', 70) || chr(10)
    || '# dn: cn=' || c_name || chr(10) || '# cn: a' || chr(10) || '# ' || repeat('=', 70) || chr(10) || '# CONVERTED OUD Entry (active)' || chr(10) || '# ' || repeat('=', 70) || chr(10) || 'dn: cn=' || c_name || chr(10) || 'cn: ' || c_name AS ldif, CAST(11 AS INTEGER) AS n_read, TRUE AS same FROM customer""")
def comments_written(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on a conversion and the original entry as comments: written with one sign each, and read back as they were."""
    name = F.col("c_name")
    change = lambda kind, a, x, y: F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("attribute"), F.lit(x).alias("original"), y.cast("string").alias("converted"))
    notes = C.change_comments(F.array(change("removed", "l", "x", F.lit(None)), change("changed", "cn", "a", name), change("added", "sn", "", name)), F.lit("No category match"))
    block = C.original_comment(F.concat(F.lit("dn: cn="), name, F.lit("\ncn: a")))
    e = tree.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("cn="), name).alias("dn"), A.entry_attrs(A.attr("cn", name)).cast(ATTRS).alias("attrs"), C.as_comments(notes, F.split(block, "\n")).alias("comments"))
    text = ldif.written(e, comments=True)
    back = ldif.parse(text.select("c_custkey", "ldif", F.col("comments").alias("told"), F.col("ldif").alias("record")))
    return back.select("c_custkey", "ldif", F.size("comments").alias("n_read"), (F.col("comments") == F.col("told")).alias("same"))
