"""Further operators over entries: dialect signatures, schema scans, whitelists, differences, reports and pattern filters."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake import dialects as D
from dirlake.functions import attrs as A
from dirlake.functions import schema4512 as S
from dirlake.functions.dn import depth, norm_dn, strip


def _starts(names: Column, prefix: str) -> Column:
    return F.exists(names, lambda n: n.startswith(prefix))


def looks_like(dn: Column, attrs: Column, dialect: str) -> Column:
    """Whether a name, an attribute name or an object class of an entry is one of a dialect's signs."""
    sign = D.SIGNATURES.get(dialect, D.Signature())
    low, names = F.lower(dn), A.lower_names(attrs)
    tests = [low.contains(m) for m in sign.dn] + [_starts(names, p) for p in sign.prefixes]
    if sign.classes:
        tests.append(F.arrays_overlap(F.transform(A.object_classes(attrs), F.lower), F.array(*map(F.lit, sign.classes))))
    if sign.attributes:
        tests.append(F.arrays_overlap(names, F.array(*map(F.lit, sign.attributes))))
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def tag(df: DataFrame, dialect: str) -> DataFrame:
    """`df` with the dialect and whether an entry is one of its configuration entries, by its name."""
    low = F.lower(F.col("dn"))
    signs = [low.contains(m) for m in D.SIGNATURES.get(dialect, D.Signature()).dn]
    return df.withColumn("server_type", F.lit(dialect)).withColumn("is_config_entry", reduce(lambda a, b: a | b, signs, F.lit(False)))


def schema_items(df: DataFrame) -> DataFrame:
    """(dn, kind, definition) of every definition in schema entries, whatever the case of their attributes' names."""
    each = df.select("dn", F.explode("attrs").alias("a")).where(F.lower("a.name").isin("attributetypes", "objectclasses"))
    return each.select("dn", F.when(F.lower("a.name") == "objectclasses", "objectclass").otherwise("attribute").alias("kind"), F.explode("a.values.value").alias("definition")).withColumn("definition", F.regexp_replace("definition", r"(?i)^\s*(?:attributetypes?|objectclass(?:es)?)[:\s]+(?=\()", ""))


def whitelist_values(attrs: Column, allowed: Sequence[str]) -> Column:
    """Schema attributes with only those definitions whose OID is allowed; an emptied attribute goes. Without a whitelist, all definitions with an OID go."""
    keep = lambda v: S.oid_of(v["value"]).isNull() | (S.oid_allowed(v["value"], list(allowed)) if allowed else F.lit(False))
    own = lambda a: F.lower(a["name"]).isin(*A.SCHEMA_ATTRS)
    out = F.transform(attrs, lambda a: F.struct(a["name"].alias("name"), F.when(own(a), F.filter(a["values"], keep)).otherwise(a["values"]).alias("values")))
    return F.filter(out, lambda a: F.size(a["values"]) > 0)


def whitelist_entries(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Schema entries whose first definition's OID is allowed; all of them without a whitelist."""
    if not allowed:
        return df
    firsts = [A.first_value(F.col("attrs"), n) for n in A.SCHEMA_ATTRS]
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(S.oid_allowed(v, list(allowed)), F.lit(False)) for v in firsts)))


def minimal_difference(original: Column, converted: Column) -> Column:
    """A struct that tells whether two texts differ, their lengths, and both texts only where they do."""
    changed = ~original.eqNullSafe(converted)
    return F.struct(changed.alias("has_differences"), F.length(original).alias("original_length"), F.length(converted).alias("converted_length"), F.when(changed, original).alias("original"), F.when(changed, converted).alias("converted"))


def entry_statistics(before: Column, after: Column) -> Column:
    """A struct of what changed between two states of an entry's attributes."""
    x, y = A.lower_names(before), A.lower_names(after)
    added, removed = F.array_except(y, x), F.array_except(x, y)
    changed = F.filter(F.array_intersect(x, y), lambda n: F.to_json(F.filter(before, lambda a: F.lower(a["name"]) == n)["values"]) != F.to_json(F.filter(after, lambda a: F.lower(a["name"]) == n)["values"]))
    oc = F.sort_array(A.object_classes(before)) != F.sort_array(A.object_classes(after))
    return F.struct(added.alias("added"), removed.alias("removed"), changed.alias("modified"), oc.alias("objectclasses_changed"), (F.size(added) + F.size(removed) + F.size(changed)).alias("total_attribute_changes"))


def merge_statistics(df: DataFrame, key: str, counts: Sequence[str], firsts: Sequence[str] = (), maps: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Rows of counts of parts (files, runs) as one row for each key, with the share of the first count in the second, if there are two.

    Of `firsts` the first value that is not null stays, by `order` (any, without one); the numbers in `maps`, such as those of reasons, are added by their keys. Maps
    are added up key by key before they are put together, so a key with any number of parts is safe; a key without any entry has an empty map.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.first(c, ignorenulls=True)
    out = df.groupBy(key).agg(*(F.sum(c).alias(c) for c in counts), *(first(c).alias(c) for c in firsts))
    for m in maps:
        each = df.select(F.col(key).alias("_key"), F.explode(m).alias("k", "v")).groupBy("_key", "k").agg(F.sum("v").alias("v"))
        whole = each.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(m))
        out = out.join(whole, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(m, F.coalesce(m, F.create_map().cast(whole.schema[m].dataType)))
    if len(counts) < 2:
        return out
    total = F.col(counts[1])
    return out.withColumn("rate", F.when(total == 0, 0.0).otherwise(F.round(100.0 * F.col(counts[0]) / total, 2)))


def server_types(df: DataFrame, column: str = "server_type") -> DataFrame:
    """(server_type, n): how many entries each dialect has; those without one are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("server_type")).agg(F.count("*").alias("n"))


def structural_violations(attrs: Column) -> Column:
    """More than one structural class, and attributes that a domain may not have."""
    low = F.transform(A.object_classes(attrs), F.lower)
    found = F.sort_array(F.array_intersect(low, F.array(*map(F.lit, D.STRUCTURAL))))
    many = F.when(F.size(found) > 1, F.array(F.concat(F.lit("Multiple structural objectClasses: "), F.array_join(found, ", ")))).otherwise(F.array().cast("array<string>"))
    bad = F.filter(A.names(attrs), lambda n: F.array_contains(low, "domain") & F.lower(n).isin(*D.NOT_IN_DOMAIN))
    return F.concat(many, F.transform(bad, lambda n: F.concat(F.lit("'"), n, F.lit("' not allowed by RFC 4519 domain"))))


def by_dn(df: DataFrame, pattern: str) -> DataFrame:
    """Entries whose name matches a shell pattern, whatever the case."""
    return df.where(F.col("dn").rlike("(?i)" + fnmatch.translate(pattern).replace("\\z", "\\Z")))


def by_object_class(df: DataFrame, *classes: str) -> DataFrame:
    return df.where(F.arrays_overlap(F.transform(A.object_classes(F.col("attrs")), F.lower), F.array(*(F.lit(c.lower()) for c in classes))))


def by_attributes(df: DataFrame, *names: str, every: bool = True) -> DataFrame:
    return df.where(A.has_all(F.col("attrs"), names) if every else A.has_any(F.col("attrs"), names))


def persons(df: DataFrame) -> DataFrame:
    return by_object_class(df, "person", "inetOrgPerson", "organizationalPerson")


def groups(df: DataFrame) -> DataFrame:
    return by_object_class(df, "groupOfNames", "groupOfUniqueNames", "posixGroup")


def acl_entries(df: DataFrame, dialect: str = "rfc") -> DataFrame:
    """(dn, attribute, pos, acl): every access rule of the entries, a row for each."""
    each = df.select("dn", F.explode("attrs").alias("a")).where(A.is_acl_attribute(F.col("a.name"), dialect))
    return each.select("dn", F.col("a.name").alias("attribute"), F.posexplode("a.values.value").alias("pos", "acl"))


def oid_numbers(definition: Column) -> Column:
    """The numbers of a definition's OID, by which definitions are sorted; null without one."""
    return F.transform(F.split(S.oid_of(definition), r"\."), lambda x: x.try_cast("bigint"))


def sort_by_oid(df: DataFrame, definition: str = "definition") -> DataFrame:
    """Definitions by the numbers of their OIDs."""
    return df.orderBy(oid_numbers(F.col(definition)))


def flags(dn: Column, attrs: Column, changetype: Column, dialect: str = "rfc") -> Column:
    """A struct of an entry's derived fields: its depth, and whether it is a change, schema or access-rule entry."""
    acl = F.exists(A.names(attrs), lambda n: A.is_acl_attribute(n, dialect))
    return F.struct(depth(dn).alias("depth"), changetype.isNotNull().alias("is_change_record"), A.is_schema(attrs).alias("is_schema_entry"), acl.alias("is_acl_entry"))


def repair_class(definition: Column) -> Column:
    """An object class definition with common faults put right: misspelt AUXILIARY, missing SUP top of a structural class."""
    spelled = F.regexp_replace(definition, r"\bAUXILLARY\b", "AUXILIARY")
    lacks = spelled.rlike(r"\bSTRUCTURAL\b") & ~spelled.rlike(r"\bSUP\b")
    return F.when(lacks, F.regexp_replace(spelled, r"\bSTRUCTURAL\b", "SUP top STRUCTURAL")).otherwise(spelled)


def repair_attribute(definition: Column) -> Column:
    """An attribute type with matching rules in their own spelling and a SUBSTR rule that EQUALITY took for its own."""
    out = definition
    for wrong, right in S.RULE_SPELLINGS.items():
        out = F.regexp_replace(out, rf"\b{wrong}\b", right)
    return F.regexp_replace(out, r"EQUALITY\s+(\w*SubstringsMatch)", "EQUALITY caseIgnoreMatch SUBSTR $1")


def schema_faults(definition: Column) -> Column:
    """What a strict server would refuse: an OID that is not numeric, and several superiors."""
    raw = strip(F.regexp_extract(definition, r"\(\s*(\S+)", 1))
    one = F.when(~raw.rlike(r"^\d+(\.\d+)*$") & ~raw.rlike(r"-oid$"), F.array(F.concat(F.lit("invalid OID: "), raw))).otherwise(F.array().cast("array<string>"))
    two = F.when(definition.rlike(r"SUP\s+\([^)]*\$"), F.array(F.lit("several superiors"))).otherwise(F.array().cast("array<string>"))
    return F.concat(one, two)


def by_dn_key(df: DataFrame) -> DataFrame:
    """`df` partitioned by name, for registry and change joins that follow."""
    return df.withColumn("dn_norm", F.lower(norm_dn(F.col("dn")))).repartition("dn_norm")
