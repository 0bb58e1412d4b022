"""Queries that write files of entries and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import attrs as A, tables
from dirlake.functions import text as T
from dirlake.model import ATTRS
from dirlake.operators import compat as C
from dirlake.plans import tree
from dirlake.plans.queries import _TREE, query
from dirlake.sources import ldif, ldif_source, recover
from dirlake.storage import new_path, stored


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return tree.customers(spark, sf).withColumn("attrs", F.col("attrs").cast(ATTRS))


def _folder(spark: SparkSession, people: DataFrame) -> str:
    """A folder, whose name needs care, with files of both line ends."""
    ldif_source.register(spark)
    path = f"{new_path(spark)}/a b%1[x]"
    for crlf in (False, True):
        own = people.where((F.col("record_no") % 2 == 1) == F.lit(crlf))
        own.repartition(4).write.format("ldif").mode("append").option("crlf", str(crlf)).option("version", "true").save(path)
    return path


@query(_TREE + "SELECT c_custkey, dn, c_name AS cn, c_mktsegment AS segment, CAST(4 AS INTEGER) AS n_classes, TRUE AS readable FROM c")
def ldif_source_folder(spark: SparkSession, sf: str) -> DataFrame:
    back = spark.read.format("ldif").option("rangebytes", 1 << 16).load(_folder(spark, _people(spark, sf)))
    one = lambda name: F.get(A.values_of(F.col("attrs"), name), F.lit(0))
    return back.select(one("employeeNumber").cast("bigint").alias("c_custkey"), "dn", one("cn").alias("cn"), one("businessCategory").alias("segment"), F.size(A.object_classes(F.col("attrs"))).alias("n_classes"), F.col("error").isNull().alias("readable"))


@query("SELECT count(*) AS n, count(*) AS n_numbered, TRUE AS from_zero FROM customer")
def ldif_source_numbered(spark: SparkSession, sf: str) -> DataFrame:
    back = ldif.read_ldif(spark, _folder(spark, _people(spark, sf)), number=True)
    files = back.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("record_no").alias("n_numbered"), F.max("record_no").alias("last"), F.min("record_no").alias("first"))
    return files.agg(F.sum("n").alias("n"), F.sum("n_numbered").alias("n_numbered"), F.bool_and((F.col("first") == 0) & (F.col("last") == F.col("n") - 1)).alias("from_zero"))


def _migrated(spark: SparkSession, sf: str, by_file: bool) -> tuple[DataFrame, DataFrame]:
    """Customers as LDIF files of each region, migrated to other files; names of one nation are broken, and those of one region lie outside the base."""
    people = _people(spark, sf).withColumn("region", F.regexp_extract("dn", "ou=[^,]*,ou=([^,]*)", 1))
    people = people.withColumn("dn", F.when(F.col("dn").contains("ou=NATION_7,"), F.lit("broken")).when(F.col("region") == "ASIA", F.replace("dn", F.lit(tree.BASE), F.lit("dc=else"))).otherwise(F.col("dn")))
    ldif_source.register(spark)
    path = new_path(spark)
    ldif.written(people).select("region", "ldif").repartition("region").write.partitionBy("region").option("lineSep", "\n\n").text(f"{path}/in")
    return C.migrate_observed(spark, f"{path}/in", f"{path}/out", "oid", "oud", by_file=by_file, source_base=tree.BASE, target_base="o=new")


_MOVED = _TREE + ", m AS (SELECT CASE WHEN n_name = 'NATION_7' THEN 'invalid_dn' WHEN r_name = 'ASIA' THEN 'outside' END AS reason FROM c) "


@query(_MOVED + """SELECT metric, CAST(n AS BIGINT) AS n FROM (
    SELECT 'entries' AS metric, count(*) AS n FROM m UNION ALL SELECT 'category_' || k, CASE k WHEN 'users' THEN (SELECT count(*) FROM m WHERE reason IS NULL) WHEN 'rejected' THEN (SELECT count(*) FROM m WHERE reason IS NOT NULL) ELSE 0 END FROM (SELECT unnest(['schema', 'hierarchy', 'users', 'groups', 'acl', 'rejected']) AS k)
    UNION ALL SELECT 'reason_' || k, (SELECT count(*) FROM m WHERE reason = k) FROM (SELECT unnest(['invalid_dn', 'no_match', 'outside']) AS k)
    UNION ALL SELECT 'failed', (SELECT count(*) FROM m WHERE reason = 'invalid_dn') UNION ALL SELECT 'values', 8 * count(*) FROM m
    UNION ALL SELECT 'success_rate', CAST(round(10000.0 * count(*) FILTER (reason IS NULL) / count(*)) AS BIGINT) FROM m)""")
def migration_observed(spark: SparkSession, sf: str) -> DataFrame:
    return _migrated(spark, sf, False)[1]


@query(_MOVED + "SELECT count(*) AS entries, count(*) FILTER (reason IS NOT NULL) AS rejected, round(100.0 * count(*) FILTER (reason IS NULL) / count(*), 2) AS success_rate FROM m")
def migration_files(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up of all files, which the counts of each file add up to, as observed and as written by file."""
    found = _migrated(spark, sf, True)[0]
    told = _migrated(spark, sf, False)[0]
    found = found.join(told.where("source is null"), ["entries", "rejected", "success_rate"], "left_semi").where("source is null").unionByName(found.where("source is not null"))
    files = found.where("source is not null").agg(F.sum("entries").alias("e"), F.sum("rejected").alias("r"))
    return found.where("source is null").join(files, (F.col("e") == F.col("entries")) & (F.col("r") == F.col("rejected"))).select("entries", "rejected", "success_rate")


#: Records that break rules, with `@` as a name, and what is read of them: name|attributes|lines left out.
_BROKEN = (
    ("dn: cn=@\ncn: @\ndn: cn=b\nsn: x", "cn=@|cn=@|;cn=b|sn=x|"), ("dn: cn=@\rcn: @\r\rdn: cn=b\rcn: b", "cn=@|cn=@|;cn=b|cn=b|"), ("dn: 2.5.4.3=@\ncn: x\nno colon here\n: no name\nsn: y", "2.5.4.3=@|cn=x,sn=y|no colon here+: no name"),
    ("dn: @ no equals\r\ncn: long\r\n er\r\n", "@ no equals|cn=longer|"), ("cn: no name @", "no dn|cn=no name @|"), ("# a\ndn: cn=@\ncn: @\n# of the next\nDN: cn=b\ncn: b", "cn=@|cn=@|;cn=b|cn=b|"), ("dn: cn=@\nchangetype: modify\nadd: x\nx: 1\n-\n???", "cn=@|x=1|???"),
)


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("c_custkey") % len(_BROKEN) + 1).cast("int")
    return tree.table(spark, sf, "customer").select("c_custkey", F.replace(F.element_at(F.array(*(F.lit(x) for x, _ in _BROKEN)), k), F.lit("@"), F.col("c_name")).alias("text"))


def _read(entries: DataFrame) -> DataFrame:
    flat = F.array_join(F.flatten(F.transform("attrs", lambda a: F.transform(a["values"], lambda v: F.concat(a["name"], F.lit("="), v["value"])))), ",")
    each = entries.select("c_custkey", "record_no", F.concat_ws("|", F.coalesce("dn", "error"), flat, F.array_join("unreadable", "+")).alias("r"))
    return each.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "r"))), lambda x: x["r"]), ";").alias("result"))


_WANTED = "[" + ", ".join("'" + y.replace("'", "''") + "'" for _, y in _BROKEN) + "]"


@query(f"SELECT c_custkey, replace(({_WANTED})[CAST(c_custkey % {len(_BROKEN)} + 1 AS INTEGER)], '@', c_name) AS result FROM customer")
def ldif_recovered(spark: SparkSession, sf: str) -> DataFrame:
    return _read(recover.parse_recovering(_broken(spark, sf)))


@query(f"SELECT c_custkey, replace(({_WANTED})[CAST(c_custkey % {len(_BROKEN)} + 1 AS INTEGER)], '@', c_name) AS result FROM customer WHERE c_custkey % {len(_BROKEN)} <> 4")
def ldif_recovered_written(spark: SparkSession, sf: str) -> DataFrame:
    """What the lenient writer wrote of the entries with a name, read strictly again: nothing is lost."""
    text = recover.written_recovering(recover.parse_recovering(_broken(spark, sf))).where("ldif is not null")
    again = ldif.parse(text.select("c_custkey", "record_no", T.unfold(F.col("ldif")).alias("record")))
    return _read(recover.restore_unreadable(again.withColumn("error", F.lit(None).cast("string"))))


@query(_TREE + """, x AS (SELECT c_custkey, dn, c_name, CAST(c_custkey % 3 AS INTEGER) AS k FROM c)
SELECT c_custkey, CAST(r AS BIGINT) AS record_no, CASE r WHEN 0 THEN dn ELSE 'cn=' || r || ',' || dn END AS dn, CASE WHEN r = 0 THEN 'r' || c_custkey END AS rule_name, CASE WHEN r = 0 THEN a.kind END AS kind, CASE WHEN r = 0 THEN a.permissions END AS permissions, CASE WHEN r = 0 THEN a.rule END AS rule
FROM x, (SELECT unnest(range(0, 3)) AS r) n, (VALUES (0, 'allow', 'read,search', 'userdn self not'), (1, 'deny', 'write', 'ip 1.* userdn all or')) a(i, kind, permissions, rule) WHERE r <= k AND (r = 0 OR i = 0)""")
def tables_in_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of several records, one of which bears an instruction of two clauses, taken apart in SQL texts."""
    tables.register(spark)
    # a small file of customers makes much text to parse
    c = tree.customers(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism)
    rule = F.concat(F.lit('aci: (version 3.0; acl "r'), F.col("record_no").cast("string"), F.lit('"; allow (read, search) not userdn="ldap:///self"; deny (write) ip="1.*" or userdn="ldap:///all";)'))
    more = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("record_no") % 3).cast("int")), lambda i: F.when(i == 0, F.concat(F.lit("dn: "), "dn", F.lit("\ncn: x\n"), rule)).otherwise(F.concat(F.lit("dn: cn="), i.cast("string"), F.lit(","), F.col("dn"), F.lit("\ncn: y")))), "\n\n")
    c.select(F.col("record_no").alias("c_custkey"), F.concat(F.lit("version: 1\n\n"), more).alias("text")).createOrReplaceTempView("dirlake_ldif_texts")
    shown = "array_join(transform(a.steps, s -> coalesce(s.op, concat_ws(' ', s.key, array_join(s.values, '|')))), ' ')"
    # a lateral left join reads its left side twice and joins on the argument, which would bring all nulls together
    read = stored(spark.sql("SELECT t.c_custkey, e.record_no, e.dn, get(get(filter(e.attrs, x -> lower(x.name) = 'aci'), 0).values, 0).value AS aci FROM dirlake_ldif_texts t, LATERAL parse_ldif(t.text) e"))
    read.createOrReplaceTempView("dirlake_ldif_records")
    return spark.sql(f"""
        SELECT r.c_custkey, r.record_no, r.dn, a.name AS rule_name, a.kind, array_join(a.permissions, ',') AS permissions, {shown} AS rule
        FROM dirlake_ldif_records r LEFT JOIN LATERAL parse_acl(r.aci) a ON true WHERE r.aci IS NOT NULL
        UNION ALL SELECT c_custkey, record_no, dn, NULL, NULL, NULL, NULL FROM dirlake_ldif_records WHERE aci IS NULL""")
