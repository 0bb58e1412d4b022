"""Streams run to their end over the driver's event table, so that SQL can check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dirlake.functions import attrs as A
from dirlake.sources import ldif
from dirlake.storage import new_path, stored
from dirlake.streaming import replay
from dirlake.streaming.changelog import apply_changes, windowed_counts

_TYPE = "CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'modify' END"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    # a stream reads folders or globs, and the table may be one file
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event[s].parquet")
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("UID="), F.col("user_id").cast("string"), F.lit(", ou=people")).alias("dn"), F.expr(_TYPE).alias("changetype"))


def _finish(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives for what is there now, each batch as Parquet files of its own; in complete mode the last batch is all."""
    spark = stream.sparkSession
    path = new_path(spark)
    name = lambda batch: f"{path}/rows/batch={'last' if mode == 'complete' else batch}"
    run = stream.writeStream.outputMode(mode).foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(name(batch))).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def changelog_state(spark: SparkSession, sf: str) -> DataFrame:
    out = _finish(apply_changes(_stream(spark, sf).withColumnRenamed("event_id", "seq")), "update")
    return out.groupBy("dn_norm").agg(F.max(F.struct("changes", "seq", "present")).alias("s")).select("dn_norm", "s.seq", "s.changes", "s.present")


def changelog_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _finish(windowed_counts(_stream(spark, sf)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: Fixed value: numbers of events in a block, whose renames one row holds.
_BLOCK = 10_000


def _names(e: DataFrame) -> DataFrame:
    """(block, unit, units, unit_before, tops, top_before): the events of a block that rename a unit and the unit above it, and the last ones before the block."""
    at = lambda is_one: F.array_sort(F.collect_list(F.when(is_one, F.col("event_id"))))
    units = e.groupBy("block", "unit").agg(at(F.col("event_id") % 200 == 7).alias("units"), at(F.col("event_id") % 500 == 13).alias("tops"))
    tops = units.groupBy("block").agg(F.flatten(F.collect_list("tops")).alias("tops"))
    before = lambda c, w: F.max(F.array_max(c)).over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # a block is one row in these windows
    units = units.select("block", "unit", "units", before("units", Window.partitionBy("unit")).alias("unit_before"))
    return units.join(tops.withColumn("top_before", before("tops", Window)), "block", "left")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, ts, record): the events as change records, whose names follow the renames of units and of the unit above them."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.concat(F.lit("u"), F.col("user_id") % 5).alias("unit"))
    e = e.withColumn("block", F.floor(F.col("event_id") / _BLOCK))
    # few row groups make much text to parse
    e = e.repartition(4 * spark.sparkContext.defaultParallelism).join(_names(e), ["block", "unit"], "left")
    last = lambda at, before: F.coalesce(F.array_max(F.filter(at, lambda x: x < F.col("event_id"))), before)
    called = lambda name, at, before: F.concat(F.lit("ou="), name, F.coalesce(F.concat(F.lit("R"), last(F.col(at), F.col(before)).cast("string")), F.lit("")))
    e = e.select("event_id", "ts", "user_id", "event_type", "value", "unit", called(F.col("unit"), "units", "unit_before").alias("unit_rdn"), called(F.lit("top"), "tops", "top_before").alias("top_rdn"))
    is_type = lambda t: F.col("event_type") == t
    number = F.col("event_id").cast("string")
    body = F.when(is_type("signup"), F.concat(F.lit("add\nobjectClass: person\ncn: user "), F.col("user_id").cast("string"), F.lit("\nhits: 0\nborn: "), number))
    body = body.when(is_type("error"), "delete").when(is_type("view"), "modify\nincrement: hits\nhits: 1\n-")
    body = body.when(is_type("click"), F.concat(F.lit("modify\nadd: seen\nseen: "), (F.floor("value") % 10).cast("string"), F.lit("\n-")))
    body = body.otherwise(F.concat(F.lit("modify\nreplace: last\nlast: "), number, F.lit("\n-"), F.when(F.col("event_id") % 3 == 0, F.lit("\ndelete: seen\n-")).otherwise("")))
    named = lambda k, *parts: F.struct((F.col("event_id") * 3 + k).alias("seq"), F.concat(F.lit("dn: "), *parts).alias("record"))
    renamed = lambda rdn: F.concat(F.lit("modrdn\nnewrdn: ou="), rdn, F.lit("R"), number, F.lit("\ndeleteoldrdn: 1"))
    own = named(0, F.lit("UID="), F.col("user_id").cast("string"), F.lit(", "), "unit_rdn", F.lit(","), "top_rdn", F.lit(",dc=x\nchangetype: "), body)
    unit = F.when(F.col("event_id") % 200 == 7, named(1, "unit_rdn", F.lit(","), "top_rdn", F.lit(",dc=x\nchangetype: "), renamed(F.col("unit"))))
    above = F.when(F.col("event_id") % 500 == 13, named(2, "top_rdn", F.lit(",dc=x\nchangetype: "), renamed(F.lit("top"))))
    return e.select("ts", F.explode(F.array_compact(F.array(own, unit, above))).alias("r")).select("r.seq", "ts", "r.record")


def changelog_values(spark: SparkSession, sf: str) -> DataFrame:
    """What the log leaves of every entry; its first half is applied before the second comes."""
    path = new_path(spark)
    log = stored(_log(spark, sf))
    half = spark.read.parquet(f"{sf}/events.parquet").agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] * 3 // 2
    for own in (F.col("seq") <= half, F.col("seq") > half):
        # the half is taken before its records are parsed
        entries = ldif.parse(log.where(own))
        entries.write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema(entries.schema).parquet(f"{path}/log")
        entries, renames = replay.replay(spark, replay.records(stream, time="ts"), f"{path}/work")
    users = replay.current_names(entries.where(F.contains("key", F.lit("\nuid="))), renames)
    attrs = F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), F.transform(a["values"], A.plain_value).alias("values")))
    one = lambda name: A.first_value(attrs, name)
    seen = F.array_join(F.sort_array(A.values_of(attrs, "seen")), ",")
    return users.select(F.regexp_extract("dn", r"^uid=(\d+)", 1).cast("bigint").alias("user_id"), "dn", "changes", "present", one("cn").alias("cn"), one("born").alias("born"), one("hits").alias("hits"), one("last").alias("last"), seen.alias("seen"))


QUERIES = {"changelog_state": changelog_state, "changelog_windows": changelog_windows, "changelog_values": changelog_values}
SQL = {
    "changelog_state": f"SELECT 'uid=' || user_id || ',ou=people' AS dn_norm, max(event_id) AS seq, count(*) AS changes, arg_max({_TYPE}, event_id) <> 'delete' AS present FROM events GROUP BY user_id",
    "changelog_windows": f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, {_TYPE} AS changetype, count(*) AS n FROM events GROUP BY 1, 2",
    "changelog_values": """
WITH u AS (SELECT user_id, count(*) AS changes, coalesce(max(event_id) FILTER (WHERE event_type = 'error'), -1) AS gone FROM events GROUP BY user_id),
b AS (SELECT e.user_id, min(event_id) AS born FROM events e JOIN u ON e.user_id = u.user_id AND event_type = 'signup' AND event_id > gone GROUP BY e.user_id),
l AS (SELECT e.user_id, any_value(born) AS born, count(*) FILTER (WHERE event_type = 'view') AS hits, max(event_id) FILTER (WHERE event_type = 'purchase') AS last,
    coalesce(max(event_id) FILTER (WHERE event_type = 'purchase' AND event_id % 3 = 0), -1) AS cleared FROM events e JOIN b ON e.user_id = b.user_id AND event_id >= born GROUP BY e.user_id),
s AS (SELECT l.user_id, string_agg(DISTINCT CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR), ',' ORDER BY CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR)) AS seen FROM events e JOIN l ON e.user_id = l.user_id AND event_type = 'click' AND event_id > born AND event_id > cleared GROUP BY l.user_id)
SELECT u.user_id, 'uid=' || u.user_id || ',ou=u' || u.user_id % 5 || coalesce('r' || (SELECT max(event_id) FROM events WHERE event_id % 200 = 7 AND user_id % 5 = u.user_id % 5), '')
    || ',ou=top' || coalesce('r' || (SELECT max(event_id) FROM events WHERE event_id % 500 = 13), '') || ',dc=x' AS dn, changes, born IS NOT NULL AS present,
    CASE WHEN born IS NOT NULL THEN 'user ' || u.user_id END AS cn, CAST(born AS VARCHAR) AS born, CAST(hits AS VARCHAR) AS hits, CAST(last AS VARCHAR) AS last, coalesce(seen, '') AS seen
FROM u LEFT JOIN l ON u.user_id = l.user_id LEFT JOIN s ON u.user_id = s.user_id""",
}
