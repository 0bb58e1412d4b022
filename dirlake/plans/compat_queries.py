"""Queries for what dialects do in their own way. Inputs vary by row: a row takes one of several cases, with its own name put into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import acl
from dirlake.functions import attrs as A
from dirlake.functions import dn as N
from dirlake.functions import validate as V
from dirlake.operators import compat as C
from dirlake.operators import entries as E
from dirlake.operators import more as M
from dirlake.plans import tree
from dirlake.plans.queries import _TREE, QUERIES, SQL, query
from dirlake.sources import ldif


def _lit(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def cases(name: str, pairs: list[tuple[str | None, str | None]], call: Callable[[Column], Column]) -> None:
    """A query over customers: each row's input is one of `pairs`, with `@` as its name, and the SQL has what `call` has to make of it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        k = (F.col("c_custkey") % len(pairs) + 1).cast("int")
        text = F.replace(F.element_at(F.array(*(F.lit(x).cast("string") for x, _ in pairs)), k), F.lit("@"), F.col("c_name"))
        return tree.table(spark, sf, "customer").select("c_custkey", "c_name", text.alias("x")).select("c_custkey", call(F.col("x")).cast("string").alias("result"))

    QUERIES[name] = run
    SQL[name] = f"SELECT c_custkey, replace(([{', '.join(_lit(y) for _, y in pairs)}])[CAST(c_custkey % {len(pairs)} + 1 AS INTEGER)], '@', c_name) AS result FROM customer"


joined = lambda c: F.array_join(c, ";")

# --- LDIF in and out ---------------------------------------------------------------------------------------------------

_RECORDS = [
    # payloads that are no text, edge blanks, links, and safe text come back byte by byte
    ("dn: cn=@\njpegPhoto:: /9j/4AAB\ncn: @", None),
    ("dn: cn=@\ndescription:: ICBsZWFkIA==\nsn: x", None),
    ("dn: cn=@\nphoto:< file:///tmp/@.jpg\nlabeledURI:< http://a/@", None),
    ("dn: cn=@\ncontrol: 1.2.3 true:< http://a/b\ncontrol: 1.2.4:: YQ==\ncontrol: 1.2.5 false\ncontrol: 1.2.6: plain\nchangetype: delete", None),
    ("dn: cn=@\nchangetype: modify\nadd: userCertificate;binary\nuserCertificate;binary:: MIIB/w==\n-\nreplace: description\ndescription:: IHg=\n-\ndelete: fax\n-", None),
    ("dn:: Y249w6k=\ncn:: w6k=\nempty:\nsn: @", None),
    ("dn: cn=@\nchangetype: modrdn\nnewrdn: cn=new@\ndeleteoldrdn: 0\nnewsuperior: ou=x", None),
    ("dn: cn=@\naci: (targetattr=\"*\")(version 3.0; acl \"a name that is long enough to pass the width of a line\"; allow (read) userdn=\"ldap:///self\";)", None),
]
cases("ldif_lossless", [(x, x) for x, _ in _RECORDS], lambda x: _rewritten(x))


def _rewritten(x: Column) -> Column:
    from dirlake.functions import records as R

    e = R.cut(x)
    names = ("dn", "changetype", "attrs", "newrdn", "newsuperior", "deleteoldrdn", "controls", "change_ops")
    return R.text_of(F.struct(*(e[n].alias(n) for n in names), F.lit(None).cast("array<string>").alias("comments")), 76)


cases(
    "ldif_foreign_values",
    [
        ("dn: cn=@\nchangetype: modify\nadd: mail\nmail: a\nother: b\n-\nphone: 1\n-", "add mail=a|b / mail=a|b;phone=1"),
        ("dn: cn=@\nchangetype: modify\nreplace: x\n-\ndelete: y\ny:: IHog", "replace x=;delete y= z  / y=z"),
        ("dn: cn=@\nadd: sn\nsn: a\nSN: b\nsn: c", " / add=sn;sn=a|c;SN=b"),
    ],
    lambda x: _changes_of(x),
)


def _changes_of(x: Column) -> Column:
    from dirlake.functions import records as R

    e = R.cut(x)
    return F.concat(joined(F.transform(e["change_ops"], lambda o: F.concat(o["op"], F.lit(" "), o["attr"], F.lit("="), F.array_join(F.transform(o["values"], lambda v: v["value"]), "|")))), F.lit(" / "), A.flat(e["attrs"]))


@query("SELECT n_nationkey, [1, 1, 2][n_nationkey % 3 + 1] AS entries, [2, 3, 3][n_nationkey % 3 + 1] AS attrs FROM nation")
def ldif_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The same records with either line end, and with both in one text."""
    texts = ["dn: cn=a\r\ncn: a\r\n b\r\nsn: b\r\n", "dn: cn=a\ncn: a\nsn: b\r\ndescription: c\r\n", "dn: cn=a\r\ncn: a\r\n\r\ndn: cn=b\ncn: b\nsn: c\n"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    e = ldif.parse_text(tree.table(spark, sf, "nation").select("n_nationkey", text.alias("text")))
    return e.groupBy("n_nationkey").agg(F.count("*").cast("int").alias("entries"), F.sum(F.size("attrs")).cast("int").alias("attrs"))


@query(_TREE + "SELECT count(*) AS entries, 9 * count(*) AS lines FROM c")
def ldif_write_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = ldif.write_statistics(tree.customers(spark, sf))
    return s.select("entries", F.col("lines").alias("lines"))


_LENIENT = [("dn: 2.5.4.3=@\ncn: x", "2.5.4.3=@ relaxed ok"), ("dn: cn=@\ncn: x", "cn=@ rfc ok"), ("cn: @", "none relaxed no dn"), ("dn: @ without equals\ncn: x", "@ without equals relaxed ok")]


@query(f"SELECT c_custkey, replace(([{', '.join(_lit(y) for _, y in _LENIENT)}])[CAST(c_custkey % 4 + 1 AS INTEGER)], '@', c_name) AS result FROM customer")
def ldif_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("c_custkey") % 4 + 1).cast("int")
    records = tree.table(spark, sf, "customer").select("c_custkey", F.replace(F.element_at(F.array(*(F.lit(x) for x, _ in _LENIENT)), k), F.lit("@"), F.col("c_name")).alias("record"))
    read = C.relaxed(ldif.parse(records))
    return read.select("c_custkey", F.concat_ws(" ", F.coalesce("dn", F.lit("none")), "server_type", F.coalesce("error", F.lit("ok"))).alias("result"))


# --- names -----------------------------------------------------------------------------------------------------------------

cases(
    "dn_string_errors",
    [
        ("@", ""), (" @", "Invalid lead character: ' '"), ("#@", "Invalid lead character: '#'"), ("\\#@", ""), ("@ ", "Invalid trail character: ' '"), ("@\\ ", ""),
        ("a,b", "Invalid character at position 1: ','"), ("a\\,b", ""), ("é", "Invalid lead character: 'é'"), ("aéb", "Invalid character at position 1: 'é'"), ("", ""), (None, None), (";", "Invalid lead character: ';'"),
    ],
    lambda x: joined(N.string_errors(x)),
)
cases("dn_string_chars", [("a", "true true true"), ("#", "false true true"), (" ", "false true false"), ("+", "false false false"), ("é", "false false false"), ("\\", "false false false"), ("ab", "false false false"), ("=", "true true true")], lambda x: F.concat_ws(" ", *(N.string_char_ok(x, w).cast("string") for w in ("lead", "inner", "trail"))))
cases("dn_squeezed", [("cn = @ , dc = x", "cn=@,dc=x"), (" cn=@,dc=x ", "cn=@,dc=x"), ("cn=a b,ou= @\t,dc=x", "cn=a b,ou=@,dc=x"), (None, None)], N.squeezed)
cases("dn_norm_or_lower", [("CN=@ , DC=X", "cn=@,dc=X"), ("NO EQUALS", "no equals"), ("", ""), (None, "")], N.norm_or_lower)
cases(
    "dn_clean_cases",
    [
        ("cn = @ ,  dc=x", "cn= @,dc=x"), ("cn=a\tb,dc=@", "cn=a b,dc=@"), ("cn=a\\x@", "cn=ax@"), ("cn=a\\,b,dc=@", "cn=a\\,b,dc=@"), ("cn=a   b , o=@", "cn=a b,o=@"), ("", ""), (None, None), ("cn=\\C3\\A9,o=@", "cn=C3A9,o=@"),
    ],
    N.clean_dn,
)

# --- schema ------------------------------------------------------------------------------------------------------------------

cases("schema_relaxed_oid", [("( 1.2.3 NAME 'a@' )", "1.2.3"), ("( a-oid NAME '@' )", "a-oid"), ("NAME '@' 2.5.4 x", "2.5.4"), ("(5 NAME '@')", "5"), ("nothing", None), (None, None)], C.relaxed_oid)
cases(
    "schema_keyword",
    [
        ("attributetype ( 1.2.3 NAME '@' SYNTAX 1.3 EQUALITY caseIgnoreMatch )", "( 1.2.3 NAME '@' SYNTAX 1.3 EQUALITY caseIgnoreMatch )|attributetype ( 1.2.3 NAME '@' SYNTAX 1.3 EQUALITY caseIgnoreMatch )"),
        ("ObjectClass ( 1.2.4 NAME '@' SUP top STRUCTURAL MUST cn MAY ( sn $ l ) )", "( 1.2.4 NAME '@' SUP top STRUCTURAL MUST cn MAY ( sn $ l ) )|objectclass ( 1.2.4 NAME '@' SUP top STRUCTURAL MUST ( cn ) MAY ( sn $ l ) )"),
        ("( 1.2.5 NAME '@' EQUALITY x SYNTAX 1.4 SINGLE-VALUE )", "( 1.2.5 NAME '@' EQUALITY x SYNTAX 1.4 SINGLE-VALUE )|attributetype ( 1.2.5 NAME '@' SYNTAX 1.4 EQUALITY x SINGLE-VALUE )"),
    ],
    lambda x: F.concat_ws("|", C.without_keyword(x), C.with_keyword(C.without_keyword(x))),
)
cases("schema_extensions", [("( 1.2 NAME '@' X-ORIGIN 'RFC @' X-ORDERED 'VALUES' )", "X-ORIGIN=RFC @;X-ORDERED=VALUES"), ("( 1.2 NAME '@' )", ""), ("( 1.2 DESC 'no X-FAKE here' X-A 'b' )", "X-A=b")], lambda x: joined(F.transform(C.extensions(x), lambda e: F.concat(e["name"], F.lit("="), e["value"]))))
cases(
    "schema_formatting",
    [
        ("( 1.2 NAME ( '@' 'b' ) DESC 'the SUP of' SYNTAX '1.3' X-ORIGIN 'x' )", "NAME,DESC,SYNTAX,X-ORIGIN true true false true 0"),
        (" ( 1.2 NAME '@' OBSOLETE SUP top AUXILIARY MAY cn )", "NAME,OBSOLETE,SUP,AUXILIARY,MAY false false true false 1"),
    ],
    lambda x: F.concat_ws(" ", F.array_join(C.formatting(x)["fields"], ","), *(C.formatting(x)[c].cast("string") for c in ("names_bracketed", "syntax_quoted", "obsolete", "has_origin", "leading"))),
)
cases(
    "schema_restored",
    [("(  1.2   NAME '@'  SYNTAX '1.3' )", "(  1.2   NAME '@'  SYNTAX '1.3' )"), ("( 1.2 NAME '@' )", "( 1.2 NAME '@' )")],
    lambda x: C.restored(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "'1.3'", "1.3"), C.formatting(x)),
)
cases(
    "schema_rewrite",
    [
        ("( 1.2 NAME '@' EQUALITY caseIgnoreSubStringsMatch SYNTAX 1.3.6.1.4.1.1466.115.121.1.1 )", "( 1.2 NAME '@' EQUALITY caseIgnoreMatch SYNTAX 1.3.6.1.4.1.1466.115.121.1.15 )"),
        ("( 1.2 NAME '@' SUBSTR caseIgnoreSubStringsMatch SUP 'name' )", "( 1.2 NAME '@' SUBSTR caseIgnoreSubstringsMatch SUP name )"),
        ("( 1.2 NAME '@' SYNTAX '1.3.6.1.4.1.1466.115.121.1.1' )", "( 1.2 NAME '@' SYNTAX '1.3.6.1.4.1.1466.115.121.1.15' )"),
        ("( 1.2 NAME '@' SYNTAX 1.3.6.1.4.1.1466.115.121.1.12 )", "( 1.2 NAME '@' SYNTAX 1.3.6.1.4.1.1466.115.121.1.12 )"),
    ],
    C.rewrite_definition,
)
cases(
    "schema_convert_in_entry",
    [
        ("( 1.2 NAME '@' SUBSTR caseIgnoreSubStringsMatch )", "attributeTypes=( 1.2 NAME '@' SUBSTR caseIgnoreSubstringsMatch );cn=( 1.2 NAME '@' SUBSTR caseIgnoreSubStringsMatch )"),
        ("( 1.3 NAME '@' )", "attributeTypes=( 1.3 NAME '@' );cn=( 1.3 NAME '@' )"),
    ],
    lambda x: A.flat(C.convert_schema(F.array(A.attr("attributeTypes", x), A.attr("cn", x)).cast(_attrs()), "oid", "rfc")),
)


def _attrs() -> str:
    from dirlake.model import ATTRS

    return ATTRS


_SIGNS = ("oid", "ad", "ds389", "novell", "openldap2", "apache", "ibm_tivoli")
cases(
    "schema_dialects",
    [
        ("( 2.16.840.1.113894.1.1 NAME '@' )", "oid"), ("( 1.2.840.113556.1 NAME '@' )", "ad"), ("( 2.16.840.1.113730.3 NAME '@' )", "ds389"), ("( 9.9 NAME 'nsDS5@' )", "ds389"), ("( 9.9 NAME 'olc@' )", "openldap2"),
        ("( 1.3.6.1.4.1.18060.0 NAME '@' )", "apache"), ("( 1.3.18.0.2 NAME '@' )", "ibm_tivoli"), ("( 9.9 NAME 'sAMAccountName' )", "ad"), ("( 9.9 NAME 'x@' )", ""), ("( 2.16.840.1.113719.1 NAME '@' )", "novell"), ("( 9.9 NAME ( 'x' 'ibm-@' ) )", "ibm_tivoli"),
    ],
    lambda x: F.array_join(F.filter(F.array(*(F.when(C.definition_of(x, d), F.lit(d)) for d in _SIGNS)), lambda v: v.isNotNull()), ","),
)
cases(
    "schema_entry_modes",
    [("cn=schema,o=@", "true true"), ("cn=other,o=@", "false true"), ("cn=subschemasubentry", "true true")],
    lambda x: F.concat_ws(" ", *(C.schema_entry(x, A.entry_attrs(A.attr("attributeTypes", F.lit("( 1.2 )"))), s).cast("string") for s in (True, False))),
)
cases("schema_entry_lenient", [("subschema", "false true"), ("person", "false false"), ("SubEntry", "false true")], lambda x: F.concat_ws(" ", *(C.schema_entry(F.lit("o=x"), A.entry_attrs(A.attr("objectClass", x)), s).cast("string") for s in (True, False))))

# --- access rules --------------------------------------------------------------------------------------------------------------

cases("acl_name", [("a \"b\"  c@", "a b c@"), ("é@\tx", "@ x"), ("  @  ", "@"), ("n" * 130, "n" * 125 + "..."), ("", ""), (None, None)], C.sanitize_name)
cases("acl_renamed", [('(version 3.0; acl "@"; allow (read) userdn="ldap:///self";)', '(version 3.0; acl "new name"; allow (read) userdn="ldap:///self";)'), ('(targetattr="a")(version 3.0; ACL  "x@y"; deny (all) groupdn="g";)', '(targetattr="a")(version 3.0; ACL  "new name"; deny (all) groupdn="g";)')], lambda x: C.with_name(x, F.lit('new "name"')))
cases("acl_types", [("oracle_oid", "oid_acl"), (" OpenLDAP ", "openldap2_acl"), ("389ds", "ds389_acl"), ("x@", None)], lambda x: F.when(~x.startswith("xC"), C.rule_type(x)))
_KNOWN = "389ds, ad, oid, openldap, openldap1, openldap2, oud, relaxed, rfc"
cases("acl_violations", [("oid", ""), ("novell", f"Invalid server_type 'novell' - expected one of: {_KNOWN}"), ("rfc", ""), ("389ds", "")], lambda x: joined(C.rule_violations(x, F.lit(True), x)))
cases("acl_without_text", [(" ", "ACL is defined (has target/subject/permissions) but raw_acl is empty"), ("@", ""), (None, "ACL is defined (has target/subject/permissions) but raw_acl is empty")], lambda x: joined(C.rule_violations(F.lit("oid"), F.lit(True), x)))
cases("acl_keys", [("READ|x@|write|Read", "read|write"), ("no_add|proxy|@", "no_add|proxy"), ("", "")], lambda x: F.array_join(C.permission_keys(F.split(x, r"\|")), "|"))
_RULE_SIGNS = ("oid", "oud", "openldap2", "openldap1", "ad", "ibm_tivoli")
cases(
    "acl_dialect_of_line",
    [("orclaci: access to entry by * (none)", "oid"), ("access to attr=(@) by self (read)", "oid,openldap1,ibm_tivoli"), ("aci: (targetattr=\"@\")", "oud"), ("(targetattr=\"@\")", "oud"), ("olcAccess: {0}to * by @", "openldap2"), ("to dn=\"@\" by x", "openldap2"), ("nTSecurityDescriptor:: @", "ad"), ("plain @", "")],
    lambda x: F.array_join(F.filter(F.array(*(F.when(C.rule_of(x, d), F.lit(d)) for d in _RULE_SIGNS)), lambda v: v.isNotNull()), ","),
)
_RULES = [
    ("access to entry by self (browse)", 'cn=@;aci=(targetattr="*")(version 3.0; acl "@ Entry by self"; allow (read, search) userdn="ldap:///self";)'),
    ("access to entry by * (none)", "cn=@"),
    ("access to entry by self (fly)", "cn=@;orclaci=access to entry by self (fly)"),
    ('(version 3.0; acl "@";)', 'orclaci=(version 3.0; acl "@";)| (version 3.0; acl "@";);cn=@'),
]


@query(f"SELECT c_custkey, replace(([{', '.join(_lit(y) for _, y in _RULES)}])[CAST(c_custkey % {len(_RULES)} + 1 AS INTEGER)], '@', c_name) AS attrs FROM customer")
def acl_rules_in_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of another dialect inside entries, each there twice with another blank: translated once, dropped, or left as they are."""
    x = F.replace(F.element_at(F.array(*(F.lit(r) for r, _ in _RULES)), (F.col("c_custkey") % len(_RULES) + 1).cast("int")), F.lit("@"), F.col("c_name"))
    attrs = A.entry_attrs(A.attr("orclaci", x, F.concat(F.lit(" "), x)), A.attr("cn", F.col("c_name")))
    df = tree.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("cn="), "c_name", F.lit(",o=x")).alias("dn"), attrs.alias("attrs"))
    return acl.rewrite_rules(df).select("c_custkey", A.flat(F.col("attrs")).alias("attrs"))


# --- conversion ------------------------------------------------------------------------------------------------------------------


def _converted(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    attrs = A.entry_attrs(A.attr("orclGUID", k.cast("string")), A.attr("orclIsEnabled", F.when(k % 3 == 0, "1").when(k % 3 == 1, "0").otherwise("TRUE")), A.attr("cn", F.col("c_name")))
    df = tree.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("CN="), "c_name", F.lit(", O=x")).alias("dn"), attrs.alias("attrs"))
    return E.convert(C.remember(df), "oid", "oud").withColumn("changes", C.transformations(F.col("original.attrs"), F.col("attrs")))


@query("""SELECT c_custkey, 'orclguid:removed;entryuuid:added' || CASE c_custkey % 3 WHEN 0 THEN ';orclisenabled:changed' WHEN 1 THEN ';orclisenabled:changed' ELSE '' END AS changes,
    'orclGUID=' || c_custkey || ';orclIsEnabled=' || ['1', '0', 'TRUE'][c_custkey % 3 + 1] || ';cn=' || c_name AS restored, 'CN=' || c_name || ', O=x' AS dn FROM customer""")
def conversion_restored(spark: SparkSession, sf: str) -> DataFrame:
    back = C.restore(_converted(spark, sf))
    return back.select("c_custkey", joined(F.transform("changes", lambda c: F.concat(c["attribute"], F.lit(":"), c["kind"]))).alias("changes"), A.flat(F.col("attrs")).alias("restored"), "dn")


@query("""SELECT c_custkey, '{"original_server_type":"oid","server_type":"oud","changes":[{"attribute":"orclguid","kind":"removed","original":"' || c_custkey || '"},{"attribute":"entryuuid","kind":"added","converted":"' || c_custkey || '"}'
    || CASE c_custkey % 3 WHEN 0 THEN ',{"attribute":"orclisenabled","kind":"changed","original":"1","converted":"TRUE"}' WHEN 1 THEN ',{"attribute":"orclisenabled","kind":"changed","original":"0","converted":"FALSE"}' ELSE '' END || ']}' AS memory FROM customer""")
def conversion_memory(spark: SparkSession, sf: str) -> DataFrame:
    df = _converted(spark, sf)
    return df.select("c_custkey", C.metadata_json(df).alias("memory"))


@query("SELECT 'oid' AS original_server_type, 'oud' AS server_type, count(*) AS entries, count(*) FILTER (c_custkey % 3 < 2 OR c_custkey % 5 > 0) AS changed, count(*) FILTER (c_custkey % 7 = 0) AS failed, round(100.0 * count(*) FILTER (c_custkey % 7 > 0) / count(*), 2) AS rate FROM customer")
def conversion_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = _converted(spark, sf)
    none = F.filter("changes", lambda c: F.lit(False))
    df = df.withColumn("changes", F.when((F.col("c_custkey") % 3 < 2) | (F.col("c_custkey") % 5 > 0), F.col("changes")).otherwise(none))
    return C.conversion_metrics(df.withColumn("error", F.when(F.col("c_custkey") % 7 == 0, "x")))


cases(
    "comment_blocks",
    [("dn: cn=@\ncn: @", "# {}\n# ORIGINAL Entry (alternative format) (commented)\n# {}\n# dn: cn=@\n# cn: @\n\n# {}\n# CONVERTED OUD Entry (active)\n# {}".replace("{}", "=" * 70)), ("a\n\nb@", "# {}\n# ORIGINAL Entry (alternative format) (commented)\n# {}\n# a\n#\n# b@\n\n# {}\n# CONVERTED OUD Entry (active)\n# {}".replace("{}", "=" * 70))],
    C.original_comment,
)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '# [REJECTION] out of ' || c_name || ';' ELSE '' END || '# [REMOVED] orclguid: ' || c_custkey
    || CASE c_custkey % 3 WHEN 0 THEN ';# [TRANSFORMED] orclisenabled: 1 -> TRUE' WHEN 1 THEN ';# [TRANSFORMED] orclisenabled: 0 -> FALSE' ELSE '' END AS comments FROM customer""")
def comment_lines(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("out of "), F.regexp_extract("dn", "CN=([^,]*)", 1)))
    return _converted(spark, sf).select("c_custkey", joined(C.change_comments(F.col("changes"), reason)).alias("comments"))


@query(_TREE + """SELECT r_name AS source, count(*) AS entries, count(*) FILTER (n_name = 'NATION_7') AS rejected, round(100.0 * count(*) FILTER (n_name <> 'NATION_7') / count(*), 2) AS success_rate FROM c GROUP BY 1
    UNION ALL SELECT NULL, count(*), count(*) FILTER (n_name = 'NATION_7'), round(100.0 * count(*) FILTER (n_name <> 'NATION_7') / count(*), 2) FROM c""")
def migration_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of several files migrated whole; those with a broken name are rejected."""
    c = tree.customers(spark, sf).withColumn("source", F.regexp_extract("dn", "ou=[^,]*,ou=([^,]*)", 1))
    c = c.withColumn("dn", F.when(F.col("dn").contains("ou=NATION_7,"), F.lit("broken")).otherwise(F.col("dn")))
    return C.file_roll_up(C.migrate(c, "oid", "oud", source_base=tree.BASE, target_base="o=new"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'users' WHEN 1 THEN 'groups' WHEN 2 THEN 'rejected' ELSE 'acl' END AS category FROM customer")
def category_rules_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of the caller's own, read from JSON, beside the dialect's."""
    rules = spark.range(1).select(C.category_rules(F.lit('{"users": ["robot"], "groups": ["crowd"], "acl": ["myRights"]}')).alias("r")).first()["r"]
    k = F.col("c_custkey") % 4
    attrs = F.when(k == 3, A.entry_attrs(A.attr("myrights", F.lit("x")))).otherwise(A.entry_attrs(A.attr("objectClass", F.when(k == 0, "Robot").when(k == 1, "crowd").otherwise("thing"))))
    return tree.table(spark, sf, "customer").select("c_custkey", E.category(attrs, "rfc", rules).alias("category"))


# --- further checks of what other queries look at in one shape ---------------------------------------------------------------------

cases(
    "structural_cases",
    [("person|domain|top", "Multiple structural objectClasses: domain, person;'CN' not allowed by RFC 4519 domain"), ("person|top", ""), ("Domain", "'CN' not allowed by RFC 4519 domain"), ("groupOfNames|organization|device", "Multiple structural objectClasses: groupofnames, organization")],
    lambda x: joined(M.structural_violations(F.array(A.attr_of_array("objectClass", F.split(x, r"\|")), A.attr("CN", F.col("c_name"))).cast(_attrs()))),
)
cases("validation_names", [("cn", "true true"), ("x;binary", "false false"), ("1x", "false true"), ("", "false false"), (None, "false false"), ("a" * 65, "true false"), ("a-b", "true true")], lambda x: F.concat_ws(" ", V.attribute_name_ok(x).cast("string"), V.descriptor_ok(x).cast("string")))
cases("validation_changetype", [("add", ""), ("bogus", "RFC 2849 § 5.7: changetype 'bogus' invalid"), ("MODIFY", ""), ("x@", "RFC 2849 § 5.7: changetype 'x@' invalid")], lambda x: joined(V.rfc_violations(F.lit("cn=a"), A.entry_attrs(A.attr("cn", F.lit("a"))), x)))
cases("validation_dn_cases", [("", "RFC 2849 § 2: DN is required (empty or whitespace DN)"), (",", "RFC 4514 § 2.4: DN is empty (no RDN components)"), ("cn=@,x", "RFC 4514 § 2.3: Component 1 'x' invalid format"), ("cn=@", "")], lambda x: joined(V.dn_violations(x)))
