"""References between entries: name-valued attributes as edges, those that point nowhere, and what nested groups hold in the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlake.functions import attrs as A
from dirlake.operators.changes import key_of
from dirlake.storage import stored

#: Attributes whose values are members of a group.
MEMBERS = ("member", "uniqueMember")


def references(entries: DataFrame, names: Sequence[str] = tuple(A.DN_VALUED)) -> DataFrame:
    """(dn, key, attribute, value, target): every value of the name-valued attributes of the entries; `key` and `target` are the comparable forms of both names. Options of an attribute's name do not count; empty values are left out."""
    low = [n.lower() for n in names]
    each = entries.select("dn", F.explode("attrs").alias("a")).where(F.lower(F.substring_index("a.name", ";", 1)).isin(*low))
    each = each.select("dn", F.col("a.name").alias("attribute"), F.explode("a.values.value").alias("value")).where(F.btrim("value") != "")
    return each.select("dn", key_of(F.col("dn")).alias("key"), "attribute", "value", key_of(F.col("value")).alias("target"))


def dangling(entries: DataFrame, names: Sequence[str] = tuple(A.DN_VALUED)) -> DataFrame:
    """The references whose target is no entry. The names of the entries are one narrow column, so a target that many refer to is met by one row."""
    return references(entries, names).join(entries.select(key_of(F.col("dn")).alias("target")).distinct(), "target", "left_anti").select("dn", "key", "attribute", "value", "target")


def memberships(entries: DataFrame, names: Sequence[str] = MEMBERS) -> DataFrame:
    """(group, member) by comparable names, each once."""
    return references(entries, names).select(F.col("key").alias("group"), F.col("target").alias("member")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(group, member, depth): everything that groups hold directly or through other groups, by the fewest steps; a group on a cycle holds itself.

    Each round joins only the pairs that the last one found with the direct members of their groups and drops pairs that are known, so it ends when nothing is new, after as many rounds as the
    deepest nesting has groups, with cycles or without. Only members that are groups themselves are followed. Rounds are stored, and read again as one table.
    """
    direct = stored(edges.select("group", "member").where("group is not null and member is not null").distinct())
    groups = stored(direct.select("group").distinct())
    inner = stored(direct.join(groups.select(F.col("group").alias("member")), "member", "left_semi"))
    all_pairs = fresh = stored(direct.withColumn("depth", F.lit(1)))
    depth = 1
    # the pairs of the last round whose member is a group lead on
    while True:
        leads = fresh.join(groups.select(F.col("group").alias("member")), "member", "left_semi") if depth > 1 else inner
        step = leads.select(F.col("group"), F.col("member").alias("via")).join(direct.select(F.col("group").alias("via"), "member"), "via").select("group", "member").distinct()
        depth += 1
        fresh = stored(step.join(all_pairs, ["group", "member"], "left_anti").withColumn("depth", F.lit(depth)))
        if not fresh.limit(1).count():
            return all_pairs
        all_pairs = all_pairs.unionByName(fresh)
