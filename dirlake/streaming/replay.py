"""A change log applied to the values of a directory: which entry each record means, and what every entry holds in the end.

Names change under a log: once a unit is renamed, records name the entries below it by its new name. So each record is first resolved to
the entry that bears its name at that time, component by component from the top: a name's renames are looked up as of the record's number.
A rename is therefore one small row, whatever hangs below it, and reaches all entries of the subtree by equi-joins on their path. Resolved records are keyed by their
entry and applied by a stateful operator that keeps attributes in a map state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dirlake.functions.dn import attr_of, norm_dn, split_dn, value_of
from dirlake.storage import new_path, stored

OPS = "array<struct<op: string, attr: string, values: array<string>>>"
ENTRY = "key string, seq bigint, changes bigint, present boolean, attrs array<struct<name: string, values: array<string>>>"
RENAMES = "level int, parent string, old string, new string, seq bigint, node string"
#: Fixed value: numbers over which an entry's records are packed together.
_NEAR = 1 << 17
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def records(changes: DataFrame, seq: str = "seq", time: str | None = None) -> DataFrame:
    """Change records (dn, changetype, attrs, change_ops, newrdn, deleteoldrdn, as `read_ldif` gives them) in the form that is replayed: (seq, time, path, kind, ops, renamed).

    `path` is the name's components from the top, in lower case; `ops` what happens to values. A rename in place is `renamed` to a component, and changes the values of
    the naming attribute (the old one goes whatever its case); one to a new superior changes nothing but the count. Content records count as `add`. Records without a name are left out.
    """
    kind = F.coalesce(F.lower("changetype"), F.lit("add"))
    plain = lambda values: F.transform(values, lambda v: v["value"])
    added = F.transform("attrs", lambda a: F.struct(F.lit("add").alias("op"), a["name"].alias("attr"), plain(a["values"]).alias("values")))
    changed = F.transform("change_ops", lambda o: F.struct(F.lower(o["op"]).alias("op"), o["attr"].alias("attr"), plain(o["values"]).alias("values")))
    in_place = kind.isin("modrdn", "moddn") & F.col("newrdn").contains("=") & F.coalesce(F.col("newsuperior") == "", F.lit(True))
    named = lambda op, rdn: F.struct(F.lit(op).alias("op"), F.substring_index(rdn, "=", 1).alias("attr"), F.array(F.substring(rdn, F.instr(rdn, "=") + 1, F.length(rdn))).alias("values"))
    old = F.get(split_dn(norm_dn(F.col("dn"))), F.lit(0))
    moved = F.concat(F.when(F.col("deleteoldrdn"), F.array(named("drop", old))).otherwise(F.array().cast(OPS)), F.array(named("add", norm_dn(F.col("newrdn")))))
    ops = F.when(kind == "add", added).when(kind == "modify", changed).when(in_place, moved)
    out = changes.withColumns({"kind": kind, "ops": F.coalesce(ops.cast(OPS), F.array().cast(OPS)), "path": _path(F.col("dn")), "renamed": F.when(in_place, F.lower(norm_dn(F.col("newrdn"))))})
    # a name without `=` has no path
    return out.where(F.col("dn").contains("=")).select(F.col(seq).cast("bigint").alias("seq"), (F.col(time) if time else F.lit(None)).cast("timestamp").alias("time"), "path", "kind", "ops", "renamed")


def _path(dn: Column) -> Column:
    # without a backslash every comma separates
    plain = F.transform(F.filter(F.split(dn, ","), lambda p: p.contains("=")), lambda p: F.lower(F.concat(attr_of(p), F.lit("="), value_of(p))))
    return F.reverse(F.when(dn.contains("\\"), split_dn(F.lower(norm_dn(dn)))).otherwise(plain))


def _joined(path: Column) -> Column:
    return F.array_join(path, "\n")


def _holder(events: Column, name: Column, at: Column) -> Column:
    """Who bears a name at a time: the node that the last event before it gave the name, a new one if that took the name away, else the first one."""
    last = F.array_max(F.filter(events, lambda e: e["seq"] < at))
    return F.get(F.transform(F.array(last), lambda e: F.when(e.isNull(), name).when(e["gives"], e["node"]).otherwise(F.concat(name, F.lit("\t"), e["seq"].cast("string")))), F.lit(0))


def _history(events: DataFrame) -> DataFrame:
    """(parent, name, events): what gave or took each name, in order; as long as the renames of one name."""
    gives = events.select("parent", F.col("new").alias("name"), F.struct("seq", F.lit(True).alias("gives"), "node").alias("e"))
    takes = events.select("parent", F.col("old").alias("name"), F.struct("seq", F.lit(False).alias("gives"), F.lit(None).cast("string").alias("node")).alias("e"))
    return gives.unionByName(takes).groupBy("parent", "name").agg(F.array_sort(F.collect_list("e")).alias("events"))


def resolve(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with `ids`, the path of the entry that each means; renames that are new) for records and the renames of earlier ones.

    Levels of the tree at which nothing is ever renamed need no join. At the others, new renames are chained first (pointers are doubled until all
    chains are at their end), and those below look up their component. The other records do that last, for all levels in one plan. A record is resolved by the renames that are known when it comes.
    """
    rows = stored(rows.withColumn("ids", F.col("path")))
    moves = stored(rows.where("renamed is not null"))
    fresh = moves.select(F.size("path").alias("level")).union(known.select("level")).distinct()
    found = known.where("false")
    # as many as the tree is deep at most
    for level in sorted(r.level for r in fresh.collect()):
        old = known.where(F.col("level") == level)
        own = moves.where(F.size("path") == level).select(F.lit(level).alias("level"), _above(level).alias("parent"), F.get("path", F.lit(level - 1)).alias("old"), F.col("renamed").alias("new"), "seq")
        # a rename continues the last one before it that gave its name; a mark of its own stands for the node until the chain's end is known
        links = own.withColumn("node", F.concat(F.lit("\r"), F.col("seq").cast("string")))
        history = _history(old.unionByName(links)).withColumnRenamed("name", "old")
        chain = stored(own.join(history, ["parent", "old"]).withColumn("node", _holder(F.col("events"), F.col("old"), F.col("seq"))).drop("events"))
        while chain.where(F.startswith("node", F.lit("\r"))).limit(1).count():
            # twice before it is stored, since a round is small next to its jobs
            chain = stored(_doubled(_doubled(chain)))
        chain = chain.select(*known.columns)
        found = found.unionByName(chain)
        names = stored(_history(old.unionByName(chain)))
        moves = stored(_looked_up(moves, names, level))
        rows = _looked_up(rows, names, level)
    return rows, found


def _doubled(chain: DataFrame) -> DataFrame:
    """`chain` with the pointer that each pointer points to."""
    ends = chain.select(F.concat(F.lit("\r"), F.col("seq").cast("string")).alias("node"), F.col("node").alias("end"))
    return chain.join(ends, "node", "left").withColumn("node", F.coalesce("end", "node")).drop("end")


def _above(level: int) -> Column:
    return _joined(F.slice("ids", 1, level - 1))


def _looked_up(rows: DataFrame, names: DataFrame, level: int) -> DataFrame:
    """`rows` with the component of `ids` at a level as the node that bore its name."""
    names = names.withColumnsRenamed({"parent": "_parent", "name": "_name"})
    deep = rows.withColumns({"_p": F.when(F.size("path") >= level, _above(level)), "_n": F.get("path", F.lit(level - 1))})
    deep = deep.join(names, (F.col("_p") == F.col("_parent")) & (F.col("_n") == F.col("_name")), "left")
    deep = deep.withColumn("_held", _holder(F.col("events"), F.col("_n"), F.col("seq")))
    ids = F.when(F.col("events").isNull(), F.col("ids")).otherwise(F.transform("ids", lambda x, i: F.when(i == level - 1, F.col("_held")).otherwise(x)))
    return deep.withColumn("ids", ids).select(*rows.columns)


def current_names(entries: DataFrame, renames: DataFrame) -> DataFrame:
    """`entries`, whose `key` is the path of an entry's nodes, with `dn`, its name after all renames."""
    last = stored(renames.groupBy("level", "parent", "node").agg(F.max_by("new", "seq").alias("now")))
    out = entries.withColumns({"_ids": F.split("key", "\n"), "_now": F.transform(F.split("key", "\n"), lambda x: F.substring_index(x, "\t", 1))})
    for level in sorted(r.level for r in last.select("level").distinct().collect()):
        own = last.where(F.col("level") == level).select(F.col("parent").alias("_p"), F.col("node").alias("_n"), F.col("now").alias("_name"))
        out = out.join(own, (_joined(F.slice("_ids", 1, level - 1)) == F.col("_p")) & (F.get("_ids", F.lit(level - 1)) == F.col("_n")), "left")
        out = out.withColumn("_now", F.when(F.col("_name").isNull(), F.col("_now")).otherwise(F.transform("_now", lambda x, i: F.when(i == level - 1, F.col("_name")).otherwise(x)))).drop("_p", "_n", "_name")  # noqa: B023
    return out.withColumn("dn", F.array_join(F.reverse("_now"), ",")).drop("_ids", "_now")


class Apply(StatefulProcessor):
    """Applies the records of an entry: its attributes are a map state, its number, count and presence a value state. With `retain` seconds, an absent entry is forgotten by a timer that long after its deletion."""

    def __init__(self, retain: int | None = None) -> None:
        self.retain = retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "attr string", "name string, vals array<string>")
        self.about = handle.getValueState("about", "seq bigint, changes bigint, present boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        seq, changes, present = self.about.get() or (-1, 0, False)
        stored_values = {k[0]: (v[0], list(v[1])) for k, v in self.values.iterator()} if present else {}
        held, gone = dict(stored_values), None
        for r in sorted((r for row in rows for r in json.loads(row["records"])), key=lambda x: x["seq"]):
            changes += 1
            if r["seq"] <= seq:
                continue
            seq = r["seq"]
            if r["kind"] == "delete":
                held, present, gone = {}, False, r["time"]
            elif r["kind"] == "add":
                if not present:
                    present = True
                    _apply(held, r["ops"])
            elif present:
                _apply(held, r["ops"])
        # each call of a state is an exchange with the JVM
        for attr in stored_values.keys() | held.keys():
            if attr not in held:
                self.values.removeKey((attr,))
            elif held[attr] != stored_values.get(attr):
                self.values.updateValue((attr,), held[attr])
        self.about.update((seq, changes, present))
        if self.retain is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not present and gone is not None:
                self.handle.registerTimer(gone // 1000 + self.retain * 1000)
        yield Row(key=key[0], seq=seq, changes=changes, present=present, attrs=[Row(name=n, values=v) for _, (n, v) in sorted(held.items())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self.values.clear()
        self.about.clear()
        return iter(())

    def close(self) -> None:
        pass


def _apply(held: dict[str, tuple[str, list[str]]], ops: list[dict]) -> None:
    """Change the held attributes. Values are sets in the order in which they came; an attribute without values is none."""
    for o in ops:
        attr, values = o["attr"].lower(), o["values"] or []
        name, old = held.get(attr, (o["attr"], []))
        if o["op"] == "add":
            new = [*old, *(v for v in dict.fromkeys(values) if v not in old)]
        elif o["op"] == "delete":
            new = [v for v in old if v not in values] if values else []
        elif o["op"] == "drop":
            low = {v.lower() for v in values}
            new = [v for v in old if v.lower() not in low]
        elif o["op"] == "replace":
            new = list(dict.fromkeys(values))
        elif o["op"] == "increment" and len(values) == 1 and all(v.lstrip("-").isdigit() for v in [*old, *values]):
            new = [str(int(v) + int(values[0])) for v in old]
        else:
            continue
        if new:
            held[attr] = (name, new)
        else:
            held.pop(attr, None)


def packed(resolved: DataFrame, by_time: bool = False) -> DataFrame:
    """(key, time, records) from resolved records (seq, time, key, kind, ops): the records of an entry with close numbers as one JSON text, since a stateful operator in Python pays for each row and cell.

    `time` is the last one; `by_time` packs records of one time only.
    """
    each = F.to_json(F.struct("seq", F.unix_micros("time").alias("time"), "kind", "ops"), {"ignoreNullFields": "false"})
    near = [F.floor(F.col("seq") / _NEAR), *(["time"] if by_time else [])]
    return resolved.groupBy("key", *near).agg(F.max("time").alias("last"), F.array_join(F.collect_list(each), ",").alias("all")).select("key", F.col("last").alias("time"), F.concat(F.lit("["), "all", F.lit("]")).alias("records"))


def apply_records(records: DataFrame, retain: int | None = None, late: str = "1 hour") -> DataFrame:
    """(key, seq, changes, present, attrs) after each batch, of every entry it touches, from a stream of `packed` records (key, time, records).

    An entry's records are applied by number within a batch; one older than what has been applied only counts. Adding an entry that is there, and
    changing or deleting one that is not, change no values. With `retain`, late records are told by a watermark on `time`, so they are packed by time, and absent entries are forgotten after that many seconds.
    """
    timed = records.withWatermark("time", late) if retain is not None else records
    return timed.groupBy("key").transformWithState(Apply(retain), ENTRY, "update", "eventTime" if retain is not None else "none")


def replay(spark: SparkSession, stream: DataFrame, path: str | None = None, retain: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, renames): what a stream of `records` leaves, in two queries that run to the end of what is there.

    The first resolves each batch and appends it to a table of records by entry, and its renames to another; each batch is a folder that a repeated run of it
    overwrites. The second applies that table. `path` keeps tables and checkpoints, so that a later call goes on where this one ended. `entries` has the last row of each entry.
    """
    path = path or new_path(spark)

    def resolved(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(RENAMES + ", batch bigint").option("recursiveFileLookup", "false").parquet(f"{path}/renames").where(F.col("batch") < number).drop("batch")
        rows, renames = resolve(batch, before)
        renames.write.mode("overwrite").parquet(f"{path}/renames/batch={number}")
        keyed = rows.select("seq", "time", _joined(F.col("ids")).alias("key"), "kind", "ops")
        packed(keyed, retain is not None).write.mode("overwrite").parquet(f"{path}/records/batch={number}")

    spark.createDataFrame([], RENAMES).write.mode("overwrite").parquet(f"{path}/renames/batch=-1")
    stream.writeStream.foreachBatch(resolved).option("checkpointLocation", f"{path}/state-resolve").trigger(availableNow=True).start().awaitTermination()
    names = "key string, time timestamp, records string, batch bigint"
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        states = apply_records(spark.readStream.schema(names).parquet(f"{path}/records").drop("batch"), retain)
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/entries/batch={n}")
        states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state-apply").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, own) if own else spark.conf.unset(_PROVIDER)
    every = spark.read.schema(ENTRY + ", batch bigint").parquet(f"{path}/entries")
    last = Window.partitionBy("key").orderBy(F.col("batch").desc())
    return every.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch"), spark.read.schema(RENAMES + ", batch bigint").parquet(f"{path}/renames").drop("batch")
