"""One query for each operator family, over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import acl, acl_dialects as L, attrs as A, dn as N, schema4512 as S, syntaxes as Y, text as T, validate as V
from dirlake.operators import entries as E, more as M
from dirlake.plans import tree
from dirlake.sources import ldif

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, and its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: The tree in SQL.
_TREE = """
WITH n AS (SELECT n_nationkey, n_name, r_name, 'ou=' || n_name || ',ou=' || r_name || ',dc=example,dc=com' AS unit FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey, c_name, c_mktsegment, n_name, r_name, unit, 'cn=' || c_name || ',' || unit AS dn FROM customer JOIN n ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey, s_name, n_name, r_name, unit, 'cn=' || s_name || ',' || unit AS dn FROM supplier JOIN n ON s_nationkey = n_nationkey),
p AS (SELECT p_partkey, p_name, 'serialNumber=' || p_partkey || ',ou=Parts,dc=example,dc=com' AS dn FROM part),
u AS (SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS ou, 'ou=' || r_name || ',dc=example,dc=com' AS dn FROM region UNION ALL SELECT n_nationkey + 100, n_name, unit FROM n)
"""


# --- names -----------------------------------------------------------------------------------------------------------


def _messy(spark: SparkSession, sf: str) -> DataFrame:
    return tree.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" CN = "), "c_name", F.lit("\\, Inc , OU=Sales+L=x , ,DC=Example")).alias("dn"))


@query("SELECT c_custkey, 'CN = ' || c_name || '\\, Inc|OU=Sales+L=x|DC=Example' AS parts, CAST(3 AS INTEGER) AS n FROM customer")
def dn_split(spark: SparkSession, sf: str) -> DataFrame:
    return _messy(spark, sf).select("c_custkey", F.array_join(N.split_dn(F.col("dn")), "|").alias("parts"), N.depth(F.col("dn")).alias("n"))


@query("SELECT c_custkey, 'cn=' || c_name || '\\, Inc,ou=Sales+L=x,dc=Example' AS norm, 'ou=Sales+L=x,dc=Example' AS parent FROM customer")
def dn_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _messy(spark, sf).select("c_custkey", N.norm_dn(F.col("dn")).alias("norm"), N.parent(F.col("dn")).alias("parent"))


@query(_TREE + "SELECT c_custkey, unit || ';ou=' || r_name || ',dc=example,dc=com;dc=example,dc=com;dc=com' AS above FROM c")
def dn_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return tree.customers(spark, sf).select(F.col("record_no").alias("c_custkey"), F.array_join(N.ancestors(F.col("dn")), ";").alias("above"))


@query("SELECT c_custkey, 'CN:' || c_name || '|OU:Sales|L:x' AS pairs FROM customer")
def dn_parse(spark: SparkSession, sf: str) -> DataFrame:
    name = tree.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("CN="), "c_name", F.lit(", OU=Sales+L=x")).alias("dn"))
    return name.select("c_custkey", F.array_join(F.transform(N.rdn_pairs(F.col("dn")), lambda p: F.concat(p["attr"], F.lit(":"), p["value"])), "|").alias("pairs"))


@query(_TREE + "SELECT c_custkey, dn FROM c WHERE r_name = 'ASIA'")
def dn_under_base(spark: SparkSession, sf: str) -> DataFrame:
    return E.by_base(tree.customers(spark, sf), "OU=asia," + tree.BASE).select(F.col("record_no").alias("c_custkey"), "dn")


@query("SELECT c_custkey, CASE WHEN lower(c_name) < lower('Customer#000000500') THEN -1 WHEN lower(c_name) > lower('Customer#000000500') THEN 1 ELSE 0 END AS cmp FROM customer")
def dn_compare(spark: SparkSession, sf: str) -> DataFrame:
    dn = F.concat(F.lit("CN= "), "c_name", F.lit(",DC=x"))
    return tree.table(spark, sf, "customer").select("c_custkey", N.compare_dn(dn, F.lit("cn=CUSTOMER#000000500,dc=x")).alias("cmp"))


@query("SELECT p_partkey, '\\23' || replace(p_name, ' ', '\\2c') || '\\2b\\3c\\20' AS escaped, '#' || replace(p_name, ' ', ',') || '+< ' AS back FROM part")
def dn_escape_unescape(spark: SparkSession, sf: str) -> DataFrame:
    escaped = N.esc(F.concat(F.lit("#"), F.replace(F.col("p_name"), F.lit(" "), F.lit(",")), F.lit("+< ")))
    return tree.table(spark, sf, "part").select("p_partkey", escaped.alias("escaped"), N.unesc(escaped).alias("back"))


@query("SELECT c_custkey, 'cn=' || c_name || 'x,ou=a b,dc=c' AS cleaned, true AS tabs, true AS escapes FROM customer")
def dn_clean(spark: SparkSession, sf: str) -> DataFrame:
    stats = N.clean_dn_stats(F.concat(F.lit("cn ="), "c_name", F.lit("\\x ,  ou=a\t  b,dc=c")))
    return tree.table(spark, sf, "customer").select("c_custkey", stats.alias("s")).select("c_custkey", "s.cleaned", F.col("s.had_tabs").alias("tabs"), F.col("s.had_needless_escapes").alias("escapes"))


@query(_TREE + "SELECT c_custkey, 'cn=' || c_name || ',ou=' || n_name || ',ou=' || r_name || ',o=new' AS dn FROM c")
def dn_rebase(spark: SparkSession, sf: str) -> DataFrame:
    return tree.customers(spark, sf).select(F.col("record_no").alias("c_custkey"), N.rebase(F.col("dn"), "DC=example,dc=com", "o=new").alias("dn"))


@query("SELECT c_custkey, c_custkey % 4 = 0 AS valid FROM customer")
def dn_validate(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.element_at(F.array(F.lit("cn=a\\,b,dc=x"), F.lit("cn=a\\\\b"), F.lit("cn=a\\#b"), F.lit("2.5.4.3=x,dc=y")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return tree.table(spark, sf, "customer").select("c_custkey", N.is_valid_dn(bad).alias("valid"))


@query("SELECT 'ou=' || lower(c_mktsegment) || ',dc=x' AS key, 3 AS variants, false AS consistent FROM customer GROUP BY c_mktsegment")
def dn_registry(spark: SparkSession, sf: str) -> DataFrame:
    c = tree.table(spark, sf, "customer")
    spelled = c.select("c_custkey", F.explode(F.array(F.concat(F.lit("ou="), "c_mktsegment", F.lit(",dc=x")), F.concat(F.lit("OU="), "c_mktsegment", F.lit(", dc=x")), F.concat(F.lit("ou="), F.lower("c_mktsegment"), F.lit(", DC=x")))).alias("dn"))
    return N.registry(spelled, "dn", "c_custkey").select("key", F.col("variants").cast("int").alias("variants"), "consistent")


# --- LDIF ------------------------------------------------------------------------------------------------------------


def _round_trip(df: DataFrame) -> DataFrame:
    return ldif.parse_text(ldif.written(df).select("record_no", F.concat(F.lit("version: 1\n"), "ldif", F.lit("\n")).alias("text")).withColumnRenamed("record_no", "k"))


@query(_TREE + "SELECT c_custkey, dn, 'objectClass=top|person|organizationalPerson|inetOrgPerson;cn=' || c_name || ';sn=' || c_name || ';employeeNumber=' || c_custkey || ';businessCategory=' || c_mktsegment AS attrs FROM c")
def ldif_roundtrip_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(tree.customers(spark, sf)).select(F.col("k").alias("c_custkey"), "dn", A.flat(F.col("attrs")).alias("attrs"))


_DOC_TEXT = r"regexp_replace(regexp_replace(coalesce(text, ''), '^[ \t\n\r\x0b\x0c]+', ''), '[ \t\n\r\x0b\x0c]+$', '')"


@query(f"SELECT doc_id, 'cn=' || doc_id || ',ou=docs' AS dn, md5({_DOC_TEXT}) AS digest, lang FROM documents")
def ldif_roundtrip_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks and any characters survive base64 and folding; parsing trims edge blanks."""
    d = tree.table(spark, sf, "documents").select(F.col("doc_id").alias("record_no"), F.concat(F.lit("cn="), F.col("doc_id").cast("string"), F.lit(",ou=docs")).alias("dn"), A.entry_attrs(A.attr("description", F.coalesce("text", F.lit(""))), A.attr("l", F.col("lang"))).alias("attrs"))
    return _round_trip(d).select(F.col("k").alias("doc_id"), "dn", F.md5(A.first_value(F.col("attrs"), "description")).alias("digest"), A.first_value(F.col("attrs"), "l").alias("lang"))


@query("SELECT doc_id, true AS narrow, true AS same FROM documents")
def ldif_fold(spark: SparkSession, sf: str) -> DataFrame:
    """No folded line is over 76 bytes, and unfolding gives the line back."""
    line = F.regexp_replace(F.concat(F.lit("description: "), F.coalesce("text", F.lit(""))), r"[\n\r]", " ")
    d = tree.table(spark, sf, "documents").select("doc_id", line.alias("line")).withColumn("folded", T.fold_line(F.col("line")))
    return d.select("doc_id", F.forall(F.split("folded", "\n"), lambda x: F.octet_length(x) <= 76).alias("narrow"), (T.unfold(F.col("folded")) == F.col("line")).alias("same"))


@query(r"SELECT doc_id, coalesce(regexp_matches(text, '^[ :<]') OR regexp_matches(text, ' $') OR regexp_matches(text, '[^\x01-\x7F]|[\n\r]'), false) AS needs FROM documents")
def ldif_needs_base64(spark: SparkSession, sf: str) -> DataFrame:
    return tree.table(spark, sf, "documents").select("doc_id", T.needs_base64(F.col("text")).alias("needs"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    e = tree.table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    dn = F.concat(F.lit("dn: uid="), user, F.lit(",ou=people\nchangetype: "))
    modify = F.concat(F.lit("modify\nreplace: state\nstate: "), "event_type", F.lit("\n-\nadd: seen\nseen: "), F.col("event_id").cast("string"), F.lit("\nseen: more\n-\ndelete: old\n-\n"))
    body = F.when(F.col("event_type") == "signup", F.concat(F.lit("add\nobjectClass: top\nuid: "), user)).when(F.col("event_type") == "error", F.lit("delete")).when(F.col("event_type") == "view", F.concat(F.lit("modrdn\nnewrdn: uid=n"), user, F.lit("\ndeleteoldrdn: 1\nnewsuperior: ou=new"))).otherwise(modify)
    return ldif.parse_text(e.select("event_id", F.concat(dn, body).alias("text")))


@query("""
SELECT event_id, 'uid=' || user_id || ',ou=people' AS dn,
    CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'modrdn' ELSE 'modify' END AS changetype,
    CASE WHEN event_type IN ('signup', 'error', 'view') THEN '' ELSE 'replace state=' || event_type || ';add seen=' || event_id || '|more;delete old=' END AS ops,
    CASE WHEN event_type = 'view' THEN 'uid=n' || user_id END AS newrdn, CASE WHEN event_type = 'view' THEN true END AS deleteoldrdn, CASE WHEN event_type = 'view' THEN 'ou=new' END AS newsuperior
FROM events""")
def ldif_change_records(spark: SparkSession, sf: str) -> DataFrame:
    op = lambda o: F.concat(o["op"], F.lit(" "), o["attr"], F.lit("="), F.array_join(F.transform(o["values"], lambda v: v["value"]), "|"))
    return _changes(spark, sf).select("event_id", "dn", "changetype", F.array_join(F.transform("change_ops", op), ";").alias("ops"), "newrdn", "deleteoldrdn", "newsuperior")


@query("SELECT r_regionkey, '1.2.840.113556.1.4.805' AS control_type, r_regionkey % 2 = 0 AS criticality, 'name ' || r_name AS value, 'base64' AS value_origin, 'delete' AS changetype FROM region")
def ldif_controls(spark: SparkSession, sf: str) -> DataFrame:
    r = tree.table(spark, sf, "region")
    line = F.concat(F.lit("dn: ou=x\ncontrol: 1.2.840.113556.1.4.805 "), F.when(F.col("r_regionkey") % 2 == 0, "true").otherwise("false"), F.lit(":: "), T.to_base64(F.concat(F.lit("name "), "r_name")), F.lit("\nchangetype: delete\n"))
    return ldif.parse_text(r.select("r_regionkey", line.alias("text"))).select("r_regionkey", "changetype", F.explode("controls").alias("c")).select("r_regionkey", "c.control_type", "c.criticality", "c.value", "c.value_origin", "changetype")


@query("SELECT n_nationkey, 'url' AS origin, 'http://example.org/' || n_name AS value, 'first line second' AS description, 'a note' AS comments FROM nation")
def ldif_urls_comments_folds(spark: SparkSession, sf: str) -> DataFrame:
    n = tree.table(spark, sf, "nation")
    text = F.concat(F.lit("version: 1\n# a note\ndn: ou=x\njpegPhoto:< http://example.org/"), "n_name", F.lit("\ndescription: first\n  line\n  second\nno colon here\n\n\n"))
    return ldif.parse_text(n.select("n_nationkey", text.alias("text"))).select("n_nationkey", F.expr("attrs[0].values[0].origin").alias("origin"), A.first_value(F.col("attrs"), "jpegphoto").alias("value"), A.first_value(F.col("attrs"), "DESCRIPTION").alias("description"), F.array_join("comments", ";").alias("comments"))


@query("SELECT n_nationkey, record_no, CASE record_no WHEN 0 THEN 'no dn' WHEN 1 THEN 'invalid dn: 2.5.4.3=' || n_name END AS error FROM nation, (VALUES (0), (1), (2)) v(record_no)")
def ldif_bad_records(spark: SparkSession, sf: str) -> DataFrame:
    """Bad records stay as rows with an error."""
    text = F.concat(F.lit("cn: nobody\n\ndn: 2.5.4.3="), "n_name", F.lit("\ncn: x\n \n\ndn: cn=a\\,b,dc=x\ncn: ok"))
    return ldif.parse_text(tree.table(spark, sf, "nation").select("n_nationkey", text.alias("text"))).select("n_nationkey", "record_no", "error")


# --- attributes and filters --------------------------------------------------------------------------------------------


@query(_TREE + "SELECT c_custkey, c_name AS cn, 4 AS classes, true AS has_sn, true AS person, false AS person_wrong_case FROM c")
def attr_lookup(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("attrs")
    return tree.customers(spark, sf).select(F.col("record_no").alias("c_custkey"), A.first_value(a, "CN").alias("cn"), F.size(A.object_classes(a)).alias("classes"), A.has_attribute(a, "SN").alias("has_sn"), A.has_object_class(a, "person").alias("person"), A.has_object_class(a, "PERSON").alias("person_wrong_case"))


@query(_TREE + "SELECT dn FROM c WHERE c_mktsegment = 'BUILDING' AND r_name = 'EUROPE'")
def criteria_all(spark: SparkSession, sf: str) -> DataFrame:
    d = tree.directory(spark, sf)
    hit = E.matches(F.col("attrs"), F.col("dn"), object_classes=["PERSON", "inetorgperson"], mode="all", required=["sn"], dn_pattern="ou=europe,")
    return d.where(hit & (A.first_value(F.col("attrs"), "businesscategory") == "BUILDING")).select("dn")


@query(_TREE + "SELECT dn FROM s UNION ALL SELECT dn FROM p")
def criteria_any(spark: SparkSession, sf: str) -> DataFrame:
    d = tree.directory(spark, sf)
    return d.where(E.matches(F.col("attrs"), F.col("dn"), object_classes=["groupofnames", "device"], any_of=["member", "serialnumber"], schema=False)).select("dn")


@query(_TREE + "SELECT c_custkey, 'objectClass=top|inetOrgPerson;cn=' || c_name || ';businessCategory=' || c_mktsegment AS attrs FROM c")
def forbidden_attributes(spark: SparkSession, sf: str) -> DataFrame:
    kept = A.remove_object_classes(A.remove_attributes(F.col("attrs"), ["SN", "employeenumber"]), ["Person", "organizationalperson"])
    return tree.customers(spark, sf).select(F.col("record_no").alias("c_custkey"), A.flat(kept).alias("attrs"))


@query("SELECT c_custkey, 'orclisenabled=' || CASE WHEN c_custkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END AS rfc, 'orclisenabled=' || CASE WHEN c_custkey % 2 = 1 THEN '1' ELSE '0' END AS oid FROM customer")
def boolean_conversion(spark: SparkSession, sf: str) -> DataFrame:
    a = A.entry_attrs(A.attr("orclisenabled", (F.col("c_custkey") % 2).cast("string")))
    rfc = A.booleans_to_rfc(a)
    return tree.table(spark, sf, "customer").select("c_custkey", A.flat(rfc).alias("rfc"), A.flat(A.booleans_to_oid(rfc)).alias("oid"))


@query("SELECT c_custkey, 'cn=' || c_name || ';mail=last' AS attrs FROM customer")
def attr_normalize(spark: SparkSession, sf: str) -> DataFrame:
    a = A.entry_attrs(A.attr("CN", F.concat(F.lit("  "), "c_name", F.lit(" "))), A.attr("Mail", F.lit("first")), A.attr("MAIL", F.lit(" last "), F.lit(" ")), A.attr("empty", F.lit("  ")))
    return tree.table(spark, sf, "customer").select("c_custkey", A.flat(A.normalize(a)).alias("attrs"))


@query("SELECT c_custkey, 'entryUUID=' || c_custkey || ';aci=second;cn=' || c_name AS attrs FROM customer")
def attr_rename(spark: SparkSession, sf: str) -> DataFrame:
    a = A.entry_attrs(A.attr("orclGUID", F.col("c_custkey").cast("string")), A.attr("orclaci", F.lit("first")), A.attr("orclentrylevelaci", F.lit("second")), A.attr("CN", F.col("c_name")))
    return tree.table(spark, sf, "customer").select("c_custkey", A.flat(A.rename(a, A.OID_TO_RFC)).alias("attrs"))


@query("SELECT s_suppkey, 'member=cn=Manager,ou=a,o=new;description=ou=a,dc=example,dc=com' AS attrs FROM supplier")
def attr_rebase(spark: SparkSession, sf: str) -> DataFrame:
    a = A.entry_attrs(A.attr("member", F.lit("CN=Manager, ou=a, dc=example,dc=com")), A.attr("description", F.lit("ou=a,dc=example,dc=com")))
    return tree.table(spark, sf, "supplier").select("s_suppkey", A.flat(A.rebase_values(a, tree.BASE, "o=new")).alias("attrs"))


@query(_TREE + "SELECT c_custkey, 'objectClass=top|person|organizationalPerson|inetOrgPerson;businessCategory=' || c_mktsegment || ';cn=' || c_name || ';employeeNumber=' || c_custkey || ';sn=' || c_name AS attrs FROM c")
def attr_sort(spark: SparkSession, sf: str) -> DataFrame:
    return tree.customers(spark, sf).select(F.col("record_no").alias("c_custkey"), A.flat(A.sort_attributes(F.col("attrs"))).alias("attrs"))


# --- validation --------------------------------------------------------------------------------------------------------


def _flawed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    attrs = F.when(k % 3 == 0, A.entry_attrs(A.attr("objectClass", F.lit("top")), A.attr("cn", F.col("c_name")))).when(k % 3 == 1, A.entry_attrs(A.attr("sn;x", F.lit("café")))).otherwise(A.entry_attrs())
    return tree.table(spark, sf, "customer").select("c_custkey", F.when(k % 5 == 0, F.lit("nonsense")).otherwise(F.concat(F.lit("cn="), "c_name")).alias("dn"), attrs.alias("attrs"))


_FLAWS = """
WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nonsense' ELSE 'cn=' || c_name END AS dn, c_custkey % 5 = 0 AS bad, c_custkey % 3 AS kind FROM customer),
v AS (SELECT c_custkey, list_concat(
    CASE WHEN bad THEN ['RFC 4514 § 2.3: Component 0 ''nonsense'' invalid format'] ELSE [] END,
    CASE WHEN kind = 2 THEN ['RFC 2849 § 2: Entry must have at least one attribute (empty)'] ELSE [] END,
    CASE WHEN kind = 1 THEN ['RFC 4512 § 2.5: option ''x'' has invalid characters', 'RFC 2849 § 5.2: ''sn;x'' may need '';binary'' option'] ELSE [] END,
    CASE WHEN kind = 1 AND NOT bad THEN ['RFC 4512 § 2.3: Entry SHOULD have Naming attribute ''cn'''] ELSE [] END,
    CASE WHEN kind = 1 THEN ['RFC 4512 § 2.4.1: Entry SHOULD have objectClass (DN: ' || dn || ')'] ELSE [] END) AS v FROM f)
"""


@query(_FLAWS + "SELECT c_custkey, array_to_string(v, ';') AS violations FROM v")
def rfc_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _flawed(spark, sf).select("c_custkey", F.array_join(V.rfc_violations(F.col("dn"), F.col("attrs"), F.lit(None).cast("string")), ";").alias("violations"))


@query(_FLAWS + """SELECT c_custkey, array_to_string(list_concat(CASE WHEN kind = 1 THEN ['Server requires '';binary'' option for ''sn;x'''] ELSE [] END,
    CASE WHEN kind = 1 AND NOT bad THEN ['Server requires naming attribute ''cn'''] ELSE [] END, CASE WHEN kind > 0 THEN ['Server requires objectClass attribute'] ELSE [] END), ';') AS violations FROM f""")
def server_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _flawed(spark, sf).select("c_custkey", F.array_join(V.server_violations(F.col("dn"), F.col("attrs"), "oid"), ";").alias("violations"))


@query(_FLAWS + """SELECT count(*) AS total, count(*) FILTER (len(v) = 0) AS valid, count(*) FILTER (len(v) > 0) AS invalid, round(100.0 * count(*) FILTER (len(v) = 0) / count(*), 2) AS success_rate,
    (SELECT count(*) FROM (SELECT DISTINCT unnest(v) AS e FROM v ORDER BY e LIMIT 100)) AS errors FROM v""")
def validation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    v = _flawed(spark, sf).select(V.rfc_violations(F.col("dn"), F.col("attrs"), F.lit(None).cast("string")).alias("violations"))
    return V.roll_up(v).withColumn("errors", F.size("errors").cast("bigint"))


# --- categories, statistics, sorting -------------------------------------------------------------------------------------

_CATEGORY = _TREE + ", e AS (SELECT dn, 'users' AS category FROM c UNION ALL SELECT dn, 'groups' FROM s UNION ALL SELECT dn, 'rejected' FROM p UNION ALL SELECT dn, 'hierarchy' FROM u)"


def _categorized(dialect: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return E.categorize(tree.directory(spark, sf), dialect).select("dn", "category", "rejection_reason")

    return run


for _dialect in ("rfc", "oid", "oud"):
    QUERIES[f"categorize_{_dialect}"] = _categorized(_dialect)
    SQL[f"categorize_{_dialect}"] = _CATEGORY + "SELECT dn, category, CASE WHEN category = 'rejected' THEN 'No category match' END AS rejection_reason FROM e"


@query(_CATEGORY + ", m AS (SELECT CASE WHEN category <> 'rejected' AND dn NOT LIKE '%ou=ASIA,dc=example,dc=com' THEN 'DN not under base DN: ou=ASIA,dc=example,dc=com' WHEN category = 'rejected' THEN 'No category match' END AS rejection_reason FROM e) SELECT rejection_reason, count(*) AS n FROM m WHERE rejection_reason IS NOT NULL GROUP BY 1")
def rejection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.rejection_counts(E.categorize(tree.directory(spark, sf), "rfc", base="ou=ASIA," + tree.BASE))


@query(_CATEGORY + "SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM e GROUP BY category")
def category_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return E.pipeline_statistics(E.categorize(tree.directory(spark, sf)))


@query(_TREE + """, e AS (SELECT unnest(['top', 'person', 'organizationalPerson', 'inetOrgPerson']) AS object_class FROM c UNION ALL SELECT unnest(['top', 'groupOfNames']) FROM s
    UNION ALL SELECT unnest(['top', 'device']) FROM p UNION ALL SELECT unnest(['top', 'organizationalUnit']) FROM u) SELECT object_class, count(*) AS n FROM e GROUP BY 1""")
def object_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.object_class_counts(tree.directory(spark, sf))


@query(_TREE + "SELECT 'ou=' || n_name || ',ou=ASIA,dc=example,dc=com' AS parent, count(*) AS n FROM c WHERE r_name = 'ASIA' GROUP BY n_name")
def children_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Entries by parent under a base: an equi-join of each entry's parent with the units."""
    people = E.by_base(tree.customers(spark, sf), "ou=ASIA," + tree.BASE).select(N.parent(F.col("dn")).alias("parent"))
    return people.join(tree.units(spark, sf).select(N.norm_dn(F.col("dn")).alias("parent")), "parent").groupBy("parent").agg(F.count("*").alias("n"))


@query(_CATEGORY + "SELECT dn, row_number() OVER (ORDER BY len(string_split(dn, ',')), lower(dn)) AS place FROM (SELECT dn FROM u UNION ALL SELECT dn FROM s)")
def sort_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    both = tree.units(spark, sf).select("dn").union(tree.suppliers(spark, sf).select("dn"))
    return E.ranked(both, N.depth(F.col("dn")), F.lower(N.norm_dn(F.col("dn"))))


@query(_TREE + "SELECT lower(dn) AS key, CASE c_custkey % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'modify' END AS change FROM c WHERE c_custkey % 3 < 2 UNION ALL SELECT 'cn=new,' || lower(dn), 'add' FROM u")
def ldif_diff(spark: SparkSession, sf: str) -> DataFrame:
    old = tree.customers(spark, sf)
    new = old.where("record_no % 3 > 0").withColumn("attrs", F.when(F.col("record_no") % 3 == 1, A.remove_attributes(F.col("attrs"), ["sn"])).otherwise(F.reverse("attrs")))
    added = tree.units(spark, sf).withColumn("dn", F.concat(F.lit("CN=new, "), "dn"))
    return E.difference(old, new.unionByName(added))


# --- schema ------------------------------------------------------------------------------------------------------------


def _definitions(spark: SparkSession, sf: str) -> DataFrame:
    p = tree.table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    attribute = F.concat(F.lit("( 1.3.6.1.4.1."), k, F.lit(" NAME ( 'part"), k, F.lit("' 'alias' ) DESC '"), "p_brand", F.lit("' SUP name EQUALITY caseIgnoreMatch SUBSTR caseIgnoreSubstringsMatch SYNTAX 1.3.6.1.4.1.1466.115.121.1.15{"), F.col("p_size").cast("string"), F.lit("} SINGLE-VALUE USAGE userApplications )"))
    cls = F.concat(F.lit("( 2.5."), k, F.lit(" NAME 'class"), k, F.lit("' SUP top AUXILIARY MUST ( cn $ part"), k, F.lit(" ) MAY description )"))
    return p.select("p_partkey", "p_size", attribute.alias("attribute"), cls.alias("cls"))


@query("SELECT p_partkey, '1.3.6.1.4.1.' || p_partkey AS oid, 'part' || p_partkey AS name, p_brand AS desc, 'name' AS sup, 'caseIgnoreMatch' AS equality, 'caseIgnoreSubstringsMatch' AS substr, '1.3.6.1.4.1.1466.115.121.1.15' AS syntax, p_size AS length, true AS single_value, false AS no_user_modification, 'userApplications' AS usage FROM part")
def schema_parse_attribute(spark: SparkSession, sf: str) -> DataFrame:
    return _definitions(spark, sf).select("p_partkey", S.attribute_type(F.col("attribute")).alias("a")).select("p_partkey", "a.*").drop("ordering")


@query("SELECT p_partkey, '2.5.' || p_partkey AS oid, 'class' || p_partkey AS name, 'top' AS sup, 'AUXILIARY' AS kind, 'cn|part' || p_partkey AS must, 'description' AS may FROM part")
def schema_parse_class(spark: SparkSession, sf: str) -> DataFrame:
    o = _definitions(spark, sf).select("p_partkey", S.object_class(F.col("cls")).alias("o")).select("p_partkey", "o.*")
    return o.select("p_partkey", "oid", "name", "sup", "kind", F.array_join("must", "|").alias("must"), F.array_join("may", "|").alias("may"))


@query("SELECT p_partkey, '( 2.5.' || p_partkey || ' NAME ''class' || p_partkey || ''' SUP top AUXILIARY MUST ( cn $ part' || p_partkey || ' ) MAY description )' AS cls, '( 1.3.6.1.4.1.' || p_partkey || ' NAME ''part' || p_partkey || ''' DESC ''' || p_brand || ''' SUP name EQUALITY caseIgnoreMatch SUBSTR caseIgnoreSubstringsMatch SYNTAX 1.3.6.1.4.1.1466.115.121.1.15{' || p_size || '} SINGLE-VALUE USAGE userApplications )' AS attribute FROM part")
def schema_write(spark: SparkSession, sf: str) -> DataFrame:
    d = _definitions(spark, sf)
    return d.select("p_partkey", S.write_object_class(S.object_class(F.col("cls"))).alias("cls"), S.write_attribute_type(S.attribute_type(F.col("attribute"))).alias("attribute"))


@query("SELECT p_partkey FROM part WHERE starts_with('1.3.6.1.4.1.' || p_partkey, '1.3.6.1.4.1.1')")
def schema_oid_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return _definitions(spark, sf).where(S.oid_allowed(F.col("attribute"), ["1.3.6.1.4.1.1*", "9.9"])).select("p_partkey")


@query("SELECT 'class' || p_partkey AS object_class, 'part' || p_partkey AS attribute FROM part WHERE p_size > 25 UNION ALL SELECT 'class' || p_partkey, unnest(['cn', 'description']) FROM part")
def schema_missing_attributes(spark: SparkSession, sf: str) -> DataFrame:
    d = _definitions(spark, sf)
    classes = d.select(S.object_class(F.col("cls")).alias("o")).select("o.*")
    return S.missing_attributes(classes, d.where("p_size <= 25").select(S.attribute_type(F.col("attribute")).alias("a")).select("a.name"))


# --- access rules, detection, conversion ---------------------------------------------------------------------------------


def _acis(spark: SparkSession, sf: str) -> DataFrame:
    n = tree.nations(spark, sf)
    rule = lambda name, perms: F.concat(F.lit('(targetattr="cn||sn")(version 3.0; acl "'), F.lit(name), F.col("n_name"), F.lit(f'"; allow ({perms}) groupdn="ldap:///cn=admins,'), "unit", F.lit('";)'))
    full = F.when(F.col("n_nationkey") % 2 == 0, rule("full ", "read, write, add")).otherwise(rule("half ", "read"))
    return n.select("n_nationkey", "unit", F.posexplode(F.array(rule("read ", "read, search"), full)).alias("pos", "aci"))


@query(_TREE + """SELECT n_nationkey, 'read ' || n_name AS name, 'cn|sn' AS target_attrs, 'read|search' AS permissions, 'groupdn' AS bind_type, 'cn=admins,' || unit AS bind_value FROM n
    UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'full ' ELSE 'half ' END || n_name, 'cn|sn', CASE WHEN n_nationkey % 2 = 0 THEN 'read|write|add' ELSE 'read' END, 'groupdn', 'cn=admins,' || unit FROM n""")
def aci_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = _acis(spark, sf).select("n_nationkey", acl.parse_aci(F.col("aci")).alias("p"))
    return p.select("n_nationkey", "p.name", F.array_join("p.target_attrs", "|").alias("target_attrs"), F.explode("p.clauses").alias("c")).select("n_nationkey", "name", "target_attrs", F.array_join("c.permissions", "|").alias("permissions"), "c.bind_type", "c.bind_value")


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS granted, CASE WHEN n_nationkey % 2 = 0 THEN 'full ' || n_name END AS matched FROM nation")
def acl_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return acl.evaluate(_acis(spark, sf), "n_nationkey", ["read", "write"])


@query(_TREE + """SELECT n_nationkey, '(targetattr="*")(version 3.0; acl "' || n_name || ' Entry by admins"; allow (read, search, add, delete) groupdn="ldap:///cn=admins,' || unit || '";)' AS entry_aci,
    '(targetattr="cn||sn")(targetscope="base")(version 3.0; acl "' || n_name || ' Attrs by anyone (+1)"; allow (read, search) userdn="ldap:///anyone"; allow (read, write) userdn="ldap:///self";)' AS attr_aci FROM n""")
def oid_to_oud_aci(spark: SparkSession, sf: str) -> DataFrame:
    n = tree.nations(spark, sf)
    entry = F.concat(F.lit('access to entry by group="cn=admins,'), "unit", F.lit('" (browse,add,delete) by * (none)'))
    return n.select("n_nationkey", acl.oid_to_oud(F.col("unit"), entry)["aci"].alias("entry_aci"), acl.oid_to_oud(F.col("unit"), F.lit("access to attr=(cn,sn) by * (read,search) by self (read,write,nocompare)"))["aci"].alias("attr_aci"))


@query("SELECT r_regionkey, 'read|search|write|add' AS forward, 'browse|write|add' AS back FROM region")
def acl_permission_maps(spark: SparkSession, sf: str) -> DataFrame:
    forward = acl.oid_permissions(F.array(F.lit("browse"), F.lit("selfwrite"), F.lit("add")))
    return tree.table(spark, sf, "region").select("r_regionkey", F.array_join(forward, "|").alias("forward"), F.array_join(acl.oud_permissions(forward), "|").alias("back"))


_MARKERS = {"oid": "orclguid: 1", "oud": "DS-SYNC-hist: x", "openldap2": "olcAccess: x", "ad": "oid 1.2.840.113556.1", "novell": "2.16.840.1.113719.1", "ibm_tivoli": "ou=Tivoli x", "ds389": "dirsrv x", "rfc": "plain"}


@query("SELECT c_custkey AS source, ['rfc', 'oid', 'oud', 'openldap2', 'ad', 'novell', 'ibm_tivoli', 'ds389'][c_custkey % 8 + 1] AS dialect, round([1.0, 12.0 / 13, 14.0 / 15, 8.0 / 9, 8.0 / 9, 6.0 / 7, 6.0 / 7, 6.0 / 7][c_custkey % 8 + 1], 6) AS confidence FROM customer")
def detect_dialect(spark: SparkSession, sf: str) -> DataFrame:
    order = ["rfc", "oid", "oud", "openldap2", "ad", "novell", "ibm_tivoli", "ds389"]
    mark = F.element_at(F.array(*(F.lit(_MARKERS[m]) for m in order)), (F.col("c_custkey") % 8 + 1).cast("int"))
    lines = tree.table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), F.posexplode(F.array(F.concat(F.lit("dn: cn="), "c_name"), mark, F.lit("cn: x"))).alias("line_no", "line"))
    return E.detect(lines).drop("scores")


@query("SELECT c_custkey, 'cn=schema,o=' || c_custkey AS dn, 'entryUUID=' || c_custkey || ';orclisenabled=TRUE' AS rfc, 'orclguid=' || c_custkey || ';orclisenabled=1' AS oid FROM customer")
def convert_oid_rfc(spark: SparkSession, sf: str) -> DataFrame:
    a = A.entry_attrs(A.attr("orclGUID", F.col("c_custkey").cast("string")), A.attr("orclIsEnabled", F.lit("1")))
    df = tree.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("cn=subschemasubentry,o="), F.col("c_custkey").cast("string")).alias("dn"), a.alias("attrs"))
    there = E.convert(df, "oracle_oid", "oud")
    back = E.convert(there.select("c_custkey", F.col("dn"), F.col("attrs"), A.flat(F.col("attrs")).alias("rfc"), F.col("dn").alias("d")), "oud", "oid")
    return back.select("c_custkey", F.col("d").alias("dn"), "rfc", A.flat(F.col("attrs")).alias("oid"))


@query(_TREE + "SELECT c_custkey, 'users' AS category, 'cn=' || c_name || ',ou=' || n_name || ',ou=' || r_name || ',o=new' AS dn, 'objectclass=top|person|organizationalPerson|inetOrgPerson;cn=' || c_name || ';sn=' || c_name || ';employeenumber=' || c_custkey || ';businesscategory=' || c_mktsegment AS attrs FROM c")
def migrate_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Text in one dialect, parsed, processed, moved to another base, categorized, written and parsed again."""
    text = ldif.written(tree.customers(spark, sf)).select(F.col("record_no").alias("c_custkey"), F.col("ldif").alias("text"))
    moved = E.move_base(E.process(ldif.parse_text(text), source="oid", target="oud"), tree.BASE, "o=new")
    again = ldif.parse_text(ldif.written(E.categorize(moved, "oud", base="o=new").select("c_custkey", "category", "dn", "attrs")).select("c_custkey", "category", F.col("ldif").alias("text")))
    return again.select("c_custkey", "category", "dn", A.flat(F.col("attrs")).alias("attrs"))


@query(_TREE + "SELECT 'inetOrgPerson' AS object_class, count(*) AS n FROM c WHERE r_name = 'ASIA' UNION ALL SELECT 'organizationalPerson', count(*) FROM c WHERE r_name = 'ASIA' UNION ALL SELECT 'person', count(*) FROM c WHERE r_name = 'ASIA' UNION ALL SELECT 'top', count(*) FROM c WHERE r_name = 'ASIA'")
def ldif_asia_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: entries to LDIF text and back, those under a base, counted by object class."""
    parsed = _round_trip(tree.customers(spark, sf)).where("error is null")
    return E.object_class_counts(E.by_base(parsed, "ou=ASIA," + tree.BASE))


# --- further operators ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'directory_string' WHEN 1 THEN 'boolean' END AS syntax, CASE p_partkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' END AS kind FROM part")
def syntax_lookup(spark: SparkSession, sf: str) -> DataFrame:
    oid = F.concat(F.lit(Y.PREFIX), F.element_at(F.array(F.lit("15"), F.lit("7"), F.lit("999")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return tree.table(spark, sf, "part").select("p_partkey", Y.syntax_name(oid).alias("syntax"), Y.syntax_kind(oid).alias("kind"))


@query(_TREE + """SELECT n_nationkey, 'a|group|cn=g,' || unit || '|read,write' AS aci, 'attr|group|cn=g,' || unit || '|read,write' AS oid, 'dn.base="' || unit || '"|who|users|compare,search,read' AS openldap,
    unit || '|user|cn=t|search,read' AS novell, '*|sddl|O:BAG:DU|' AS ad FROM n""")
def acl_dialects(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("unit")
    lines = {
        "aci": ("oud", F.concat(F.lit('(targetattr="cn")(version 3.0; acl "a"; allow (read, write) groupdn="ldap:///cn=g,'), u, F.lit('";)'))),
        "oid": ("oid", F.concat(F.lit('orclaci: access to attr=(cn,sn) by group="cn=g,'), u, F.lit('" (read,write) by * (none)'))),
        "openldap": ("openldap2", F.concat(F.lit('olcAccess: {0}to dn.base="'), u, F.lit('" by users read by * none'))),
        "novell": ("novell", F.concat(u, F.lit("#cn=t#[BR]"))),
        "ad": ("ad", F.lit("nTSecurityDescriptor: O:BAG:DU")),
    }
    show = lambda a, first: F.concat_ws("|", a[first], a["subject_type"], a["subject"], F.array_join(a["permissions"], ","))
    return tree.nations(spark, sf).select("n_nationkey", *(show(L.parse_acl(line, d), "name" if k == "aci" else "target").alias(k) for k, (d, line) in lines.items()))


@query(_TREE + """SELECT n_nationkey, '(targetattr="cn||sn")(version 3.0; acl "orclaci"; allow (read, write) groupdn="ldap:///cn=g,' || unit || '";)' AS aci, 'access to attr=(cn,sn) by group="cn=g,' || unit || '" (read,write)' AS oid,
    'to attr by cn=g,' || unit || ' write' AS openldap, 'attr#cn=g,' || unit || '#[RW]' AS novell FROM n""")
def acl_translate(spark: SparkSession, sf: str) -> DataFrame:
    a = L.parse_acl(F.concat(F.lit('access to attr=(cn,sn) by group="cn=g,'), "unit", F.lit('" (read,write)')), "oid")
    return tree.nations(spark, sf).select("n_nationkey", L.write_acl(a, "oud").alias("aci"), L.write_acl(a, "oid").alias("oid"), L.write_acl(a, "openldap2").alias("openldap"), L.write_acl(a, "novell").alias("novell"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS ad, c_custkey % 3 = 1 AS oid, c_custkey % 3 = 2 AS ds389 FROM customer")
def dialect_signatures(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.lit("cn=a,CN=Users,dc=x")).otherwise(F.lit("cn=a,dc=x"))
    attrs = F.when(k % 3 == 1, A.entry_attrs(A.attr("orclGUID", F.lit("1")))).when(k % 3 == 2, A.entry_attrs(A.attr("objectClass", F.lit("nsPerson")))).otherwise(A.entry_attrs())
    return tree.table(spark, sf, "customer").select("c_custkey", *(M.looks_like(name, attrs, d).alias(d) for d in ("ad", "oid", "ds389")))


def _schema_entries(spark: SparkSession, sf: str) -> DataFrame:
    d = _definitions(spark, sf)
    return d.select("p_partkey", F.lit("cn=schema").alias("dn"), A.entry_attrs(A.attr("cn", F.lit("schema")), A.attr("attributeTypes", F.col("attribute"), F.lit("( 9.9 NAME 'x' )")), A.attr("objectClasses", F.col("cls"))).alias("attrs"))


@query("SELECT '1.3.6.1.4.1.' || p_partkey AS oid, 'attribute' AS kind FROM part UNION ALL SELECT '9.9', 'attribute' FROM part UNION ALL SELECT '2.5.' || p_partkey, 'objectclass' FROM part")
def schema_scan(spark: SparkSession, sf: str) -> DataFrame:
    return M.schema_items(_schema_entries(spark, sf)).select(S.oid_of(F.col("definition")).alias("oid"), "kind")


@query("SELECT p_partkey, 2 AS attributes, CASE WHEN starts_with('' || p_partkey, '1') THEN 2 ELSE 1 END AS types FROM part")
def schema_value_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    kept = M.whitelist_values(F.col("attrs"), ["1.3.6.1.4.1.1*", "9.9"])
    return _schema_entries(spark, sf).select("p_partkey", F.size(kept).alias("attributes"), F.size(A.values_of(kept, "attributeTypes")).alias("types"))


@query("SELECT p_partkey FROM part WHERE starts_with('' || p_partkey, '2')")
def schema_entry_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return M.whitelist_entries(_schema_entries(spark, sf), ["1.3.6.1.4.1.2*"]).select("p_partkey")


@query("SELECT p_partkey, '( 2.5.' || p_partkey || ' NAME ''c'' SUP top STRUCTURAL )' AS class, '( 1 EQUALITY caseIgnoreMatch SUBSTR caseIgnoreSubstringsMatch )' AS attribute, 'invalid OID: x' || p_partkey || ';several superiors' AS faults FROM part")
def schema_repair(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    cls, bad = F.concat(F.lit("( 2.5."), k, F.lit(" NAME 'c' STRUCTURAL )")), F.concat(F.lit("( x"), k, F.lit(" SUP ( a $ b ) )"))
    return tree.table(spark, sf, "part").select("p_partkey", M.repair_class(cls).alias("class"), M.repair_attribute(F.lit("( 1 EQUALITY caseIgnoreSubstringMatch )")).alias("attribute"), F.array_join(M.schema_faults(bad), ";").alias("faults"))


@query("SELECT c_custkey, 'mail' AS added, 'sn' AS removed, 'cn' AS modified, true AS classes, 4 AS total FROM customer")
def entry_changes(spark: SparkSession, sf: str) -> DataFrame:
    before = F.col("attrs")
    after = A.remove_object_classes(A.remove_attributes(before, ["sn", "cn"]), ["top"])
    after = F.concat(after, A.entry_attrs(A.attr("cn", F.lit("new")), A.attr("mail", F.lit("m"))))
    s = tree.customers(spark, sf).select(F.col("record_no").alias("c_custkey"), M.entry_statistics(before, after).alias("s"))
    return s.select("c_custkey", F.array_join("s.added", "|").alias("added"), F.array_join("s.removed", "|").alias("removed"), F.array_join(F.filter("s.modified", lambda n: n != "objectclass"), "|").alias("modified"), F.col("s.objectclasses_changed").alias("classes"), F.col("s.total_attribute_changes").alias("total"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS differs, len(c_name) AS n, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS original FROM customer")
def minimal_differences(spark: SparkSession, sf: str) -> DataFrame:
    d = M.minimal_difference(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")))
    return tree.table(spark, sf, "customer").select("c_custkey", d.alias("d")).select("c_custkey", F.col("d.has_differences").alias("differs"), F.col("d.original_length").alias("n"), "d.original")


@query("SELECT n_nationkey, count(*) FILTER (c_acctbal > 0) AS good, count(*) AS total, round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 2) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def merged_statistics(spark: SparkSession, sf: str) -> DataFrame:
    parts = tree.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("good"), F.count("*").alias("total"))
    return M.merge_statistics(parts, "n_nationkey", ["good", "total"])


@query("SELECT n_nationkey, 'Multiple structural objectClasses: domain, person;''CN'' not allowed by RFC 4519 domain' AS violations FROM nation")
def structural_violations(spark: SparkSession, sf: str) -> DataFrame:
    a = A.entry_attrs(A.attr("objectClass", F.lit("Person"), F.lit("domain"), F.lit("top")), A.attr("CN", F.col("n_name")))
    return tree.table(spark, sf, "nation").select("n_nationkey", F.array_join(M.structural_violations(a), ";").alias("violations"))


@query(_TREE + "SELECT dn, 'person' AS kind FROM c WHERE dn LIKE '%,ou=NATION_7,%' UNION ALL SELECT dn, 'group' FROM s WHERE dn LIKE '%,ou=NATION_7,%'")
def pattern_filters(spark: SparkSession, sf: str) -> DataFrame:
    d = M.by_dn(tree.directory(spark, sf), "cn=*,OU=nation_7,*")
    people = M.by_attributes(M.persons(d), "cn", "sn").select("dn", F.lit("person").alias("kind"))
    return people.union(M.by_attributes(M.groups(d), "member", "uniqueMember", every=False).select("dn", F.lit("group").alias("kind")))


@query(_TREE + "SELECT unit AS dn, 'aci' AS attribute, pos, CASE pos WHEN 0 THEN 'one' ELSE 'two' END AS acl FROM n, (VALUES (0), (1)) v(pos) UNION ALL SELECT unit, 'ACL', 0, n_name FROM n")
def acl_extraction(spark: SparkSession, sf: str) -> DataFrame:
    a = A.entry_attrs(A.attr("aci", F.lit("one"), F.lit("two")), A.attr("ACL", F.col("n_name")), A.attr("cn", F.lit("x")))
    return M.acl_entries(tree.nations(spark, sf).select(F.col("unit").alias("dn"), a.alias("attrs")))


@query(_TREE + "SELECT dn, CAST(len(string_split(dn, ',')) AS INTEGER) AS depth, false AS change, false AS schema, false AS acl FROM u")
def entry_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = M.flags(F.col("dn"), F.col("attrs"), F.lit(None).cast("string"))
    return tree.units(spark, sf).select("dn", f.alias("f")).select("dn", "f.depth", F.col("f.is_change_record").alias("change"), F.col("f.is_schema_entry").alias("schema"), F.col("f.is_acl_entry").alias("acl"))
