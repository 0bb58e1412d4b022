"""Two states of a directory as change records, and change records applied to a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.functions import attrs as A
from dirlake.functions.dn import norm_dn
from dirlake.model import ATTRS, CONTROLS, OPS

_VALUES = "array<struct<value: string, origin: string, raw: string>>"
_OP = OPS.removeprefix("array<").removesuffix(">")


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _identity(v: Column) -> Column:
    """What tells a value from others: its payload if it was encoded or linked, and its text."""
    return F.concat_ws("\n", F.coalesce(v["value"], F.lit("")), v["raw"])


def _counted(values: Column) -> Column:
    """(identity, which of its equals, value) for each value: with the count, a set difference is one of multisets that keeps the order."""
    same = F.transform(values, _identity)
    return F.transform(values, lambda v, i: F.struct(_identity(v).alias("id"), F.size(F.filter(F.slice(same, F.lit(1), i), lambda x: x == _identity(v))).alias("k"), v.alias("v")))


def _without(a: Column, b: Column) -> Column:
    """Counted values of `a` that `b` does not have, in their order."""
    keys = F.transform(b, lambda x: F.struct(x["id"], x["k"]))
    return F.transform(F.filter(a, lambda x: ~F.array_contains(keys, F.struct(x["id"], x["k"]))), lambda x: x["v"])


def _named(attrs: Column, low: Column) -> Column:
    return F.get(F.filter(attrs, lambda a: F.lower(a["name"]) == low), F.lit(0))


def operations(before: Column, after: Column, ordered: bool = False) -> Column:
    """The fewest operations that make one state's attributes the other's, by attribute: an attribute that goes is deleted whole, one that comes is added, and of one that changed
    either the values that went are deleted and those that came added, or all are replaced, whichever names fewer values. With `ordered`, another order of the same values is a change too.

    Attributes are the same whatever the case of their names, those of one name count as one; values are the same if their text and their payload are. Equal values count as often as they stand there.
    """
    old, new = A.merge_names(F.coalesce(before, _none(ATTRS)).cast(ATTRS)), A.merge_names(F.coalesce(after, _none(ATTRS)).cast(ATTRS))
    both = F.struct(old.alias("old"), new.alias("new"))

    def one(b: Column, low: Column) -> Column:
        x, y = _named(b["old"], low), _named(b["new"], low)
        cells = F.struct(F.coalesce(y["name"], x["name"]).alias("name"), x["values"].alias("was"), y["values"].alias("now"), _counted(F.coalesce(x["values"], _none(_VALUES))).alias("a"), _counted(F.coalesce(y["values"], _none(_VALUES))).alias("b"))
        return F.get(F.transform(F.array(cells), lambda c: _between(c["name"], c["was"], c["now"], _without(c["a"], c["b"]), _without(c["b"], c["a"]), ordered)), F.lit(0))

    lows = lambda b: F.array_distinct(F.concat(A.lower_names(b["old"]), A.lower_names(b["new"])))
    return F.flatten(F.get(F.transform(F.array(both), lambda b: F.transform(lows(b), lambda low: one(b, low))), F.lit(0))).cast(OPS)


def _between(name: Column, was: Column, now: Column, gone: Column, come: Column, ordered: bool) -> Column:
    op = lambda verb, values: F.struct(F.lit(verb).alias("op"), name.alias("attr"), values.cast(_VALUES).alias("values"))
    same = (F.size(gone) == 0) & (F.size(come) == 0)
    moved = same & (F.transform(was, _identity) != F.transform(now, _identity)) if ordered else F.lit(False)
    ids = lambda values: F.transform(F.coalesce(values, _none(_VALUES)), _identity)
    # a value whose number alone changes can be neither deleted nor added by itself
    single = ~F.arrays_overlap(ids(gone), ids(now)) & ~F.arrays_overlap(ids(come), ids(was)) & F.lit(not ordered)
    few = F.size(gone) + F.size(come) < F.size(now)
    part = F.filter(F.array(op("delete", gone), op("add", come)), lambda o: F.size(o["values"]) > 0)
    out = F.when(now.isNull() | (F.size(now) == 0), F.when(F.size(F.coalesce(was, _none(_VALUES))) > 0, F.array(op("delete", _none(_VALUES)))).otherwise(_none(OPS).cast(f"array<{_OP}>")))
    out = out.when(was.isNull() | (F.size(was) == 0), F.array(op("add", now))).when(moved, F.array(op("replace", now))).when(same, _none(OPS))
    return out.when((F.size(gone) == 0) & single, F.array(op("add", come))).when(few & single, part).otherwise(F.array(op("replace", now)))


def key_of(dn: Column) -> Column:
    return F.lower(F.coalesce(norm_dn(dn), dn, F.lit("")))


def change_records(before: DataFrame, after: DataFrame, ordered: bool = False) -> DataFrame:
    """Change records (dn, changetype, attrs, change_ops and empty other columns, ready to be written) that turn the entries of `before` into those of `after`; entries that stay give none.

    Entries are the same whatever the case and blanks of their names; a name should stand once on each side. Additions come parents first and deletions children
    first, when sorted by `place`. An entry without attributes that is added has none.
    """
    side = lambda df, s: df.select(key_of(F.col("dn")).alias("key"), F.struct("dn", F.col("attrs").cast(ATTRS).alias("attrs")).alias(s))
    both = side(before, "a").join(side(after, "b"), "key", "full_outer")
    kind = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "delete").otherwise("modify")
    ops = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), operations(F.col("a.attrs"), F.col("b.attrs"), ordered)).otherwise(_none(OPS))
    deep = F.size(F.split("key", ","))
    out = both.select(F.coalesce("b.dn", "a.dn").alias("dn"), kind.alias("changetype"), F.when(kind == "add", F.col("b.attrs")).otherwise(_none(ATTRS)).alias("attrs"), ops.alias("change_ops"), F.when(kind == "add", deep).when(kind == "modify", 1 << 20).otherwise((1 << 21) - deep).alias("place"))
    out = out.where((F.col("changetype") != "modify") | (F.size("change_ops") > 0))
    return out.withColumns({"newrdn": F.lit(None).cast("string"), "newsuperior": F.lit(None).cast("string"), "deleteoldrdn": F.lit(None).cast("boolean"), "controls": _none(CONTROLS)})


def applied(attrs: Column, ops: Column) -> Column:
    """Attributes after operations, in their order. Deleting what is not there and adding what is there change nothing; an attribute without values is none; `increment` adds to each whole number."""
    start = A.merge_names(F.coalesce(attrs, _none(ATTRS)).cast(ATTRS))

    def step(now: Column, o: Column) -> Column:
        low = F.lower(o["attr"])
        old = F.coalesce(_named(now, low)["values"], _none(_VALUES))
        known = F.transform(old, _identity)
        given = F.transform(o["values"], _identity)
        number = F.get(o["values"], F.lit(0))["value"].try_cast("bigint")
        raised = F.transform(old, lambda v: F.struct(F.coalesce((v["value"].try_cast("bigint") + number).cast("string"), v["value"]).alias("value"), v["origin"].alias("origin"), v["raw"].alias("raw")))
        new = (
            F.when(o["op"] == "add", F.concat(old, F.filter(o["values"], lambda v: ~F.array_contains(known, _identity(v)))))
            .when((o["op"] == "delete") & (F.size(o["values"]) == 0), _none(_VALUES)).when(o["op"] == "delete", F.filter(old, lambda v: ~F.array_contains(given, _identity(v))))
            .when(o["op"] == "replace", o["values"]).when(o["op"] == "increment", raised).otherwise(old)
        )
        name = F.coalesce(_named(now, low)["name"], o["attr"])
        there = F.exists(now, lambda a: F.lower(a["name"]) == low)
        changed = F.transform(now, lambda a: F.struct(a["name"].alias("name"), F.when(F.lower(a["name"]) == low, new).otherwise(a["values"]).alias("values")))
        full = F.when(there, changed).otherwise(F.concat(now, F.array(F.struct(name.alias("name"), new.cast(_VALUES).alias("values")))))
        return F.filter(full, lambda a: F.size(a["values"]) > 0).cast(ATTRS)

    return F.aggregate(F.coalesce(ops, _none(OPS)), start, step)


def apply(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """(dn, attrs) of the entries after change records, one for each name at most: deleted ones go, added ones come, unless they are there already, and modified ones change."""
    a = entries.select(key_of(F.col("dn")).alias("key"), "dn", F.col("attrs").cast(ATTRS).alias("attrs"))
    b = changes.select(key_of(F.col("dn")).alias("key"), F.struct("dn", "changetype", F.col("attrs").cast(ATTRS).alias("attrs"), F.col("change_ops").cast(OPS).alias("ops")).alias("c"))
    both = a.join(b, "key", "full_outer").where(F.col("c").isNull() | F.when(F.col("dn").isNull(), F.col("c.changetype") == "add").otherwise(F.col("c.changetype") != "delete"))
    new = F.when(F.col("dn").isNull(), F.col("c.attrs")).when(F.col("c.changetype") == "modify", applied(F.col("attrs"), F.col("c.ops"))).otherwise(F.col("attrs"))
    return both.select(F.coalesce("dn", "c.dn").alias("dn"), new.alias("attrs"))
