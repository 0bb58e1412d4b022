"""Operators over entries: criteria, categories, detection, statistics, migration. Each is a DataFrame in and a DataFrame out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlake import dialects as D
from dirlake.functions import attrs as A
from dirlake.functions.acl import rewrite_rules
from dirlake.functions.dn import depth, is_under_base, is_valid_dn, norm_dn, rebase
from dirlake.model import ATTRS
from dirlake.storage import stored


def matches(attrs: Column, dn: Column, *, object_classes: Sequence[str] = (), mode: str = "any", required: Sequence[str] = (), any_of: Sequence[str] = (), dn_pattern: str | None = None, schema: bool | None = None) -> Column:
    """Whether an entry meets all given criteria; object classes whatever their case, `mode` tells any or all of them."""
    low = F.transform(A.object_classes(attrs), F.lower)
    wanted = F.array(*(F.lit(c.lower()) for c in object_classes))
    tests = []
    if object_classes:
        tests.append(F.arrays_overlap(low, wanted) if mode == "any" else F.size(F.array_except(wanted, low)) == 0)
    if required:
        tests.append(A.has_all(attrs, required))
    if any_of:
        tests.append(A.has_any(attrs, any_of))
    if dn_pattern is not None:
        tests.append(dn.rlike(f"(?i){dn_pattern}"))
    if schema is not None:
        tests.append(A.is_schema(attrs) == F.lit(schema))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def create(dn: Column, attrs: Column, classes: Sequence[str] = ()) -> Column:
    """struct<dn, attrs, error>: an entry of a name and attributes, its object classes before them; one whose name is not valid has nothing but an error."""
    own = F.array(A.attr_of_array("objectClass", F.array(*map(F.lit, classes)))).cast(ATTRS) if classes else F.array().cast(ATTRS)
    valid = is_valid_dn(dn)
    whole = F.concat(own, F.coalesce(attrs.cast(ATTRS), F.array().cast(ATTRS)))
    return F.struct(F.when(valid, dn).alias("dn"), F.when(valid, whole).alias("attrs"), F.when(~valid, F.concat(F.lit("invalid DN: "), F.coalesce(dn, F.lit("")))).alias("error"))


def by_base(df: DataFrame, base: str) -> DataFrame:
    """Entries at or below a base."""
    return df.where(is_under_base(F.col("dn"), F.lit(base)))


def category(attrs: Column, dialect: str = "rfc", rules: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The category of an entry: schema by its attributes, then classes that mean hierarchy, then the first match in the dialect's order, else `rejected`.

    `rules` adds object classes to categories (or attributes to `acl`).
    """
    order, decisive, classes, acl = D.CATEGORIES.get(dialect, (D.CATEGORIES["rfc"][0], (), {}, ()))
    rules = rules or {}
    low = F.transform(A.object_classes(attrs), F.lower)
    out = F.when(A.is_schema(attrs), F.lit("schema"))
    if decisive:
        out = out.when(F.arrays_overlap(low, F.array(*(F.lit(c.lower()) for c in decisive))), F.lit("hierarchy"))
    for name in order:
        if name == "acl":
            out = out.when(A.has_any(attrs, [*acl, *rules.get("acl", ())]), F.lit("acl"))
        elif known := [*classes.get(name, ()), *rules.get(name, ())]:
            out = out.when(F.arrays_overlap(low, F.array(*(F.lit(c.lower()) for c in known))), F.lit(name))
    return out.otherwise(F.lit("rejected"))


def categorize(df: DataFrame, dialect: str = "rfc", base: str | None = None, rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """`df` with `category` and `rejection_reason`. Entries with an invalid name, without a match, or of a filterable category outside the base are rejected rows, never lost."""
    valid = is_valid_dn(F.col("dn"))
    out = df.withColumn("category", F.when(~valid, "rejected").otherwise(category(F.col("attrs"), dialect, rules)))
    out = out.withColumn("rejection_reason", F.when(~valid, "Invalid DN").when(F.col("category") == "rejected", "No category match"))
    if base is not None:
        outside = F.col("category").isin(*D.BY_BASE) & ~is_under_base(F.col("dn"), F.lit(base))
        out = out.withColumn("rejection_reason", F.when(outside, F.lit(f"DN not under base DN: {base}")).otherwise(F.col("rejection_reason"))).withColumn("category", F.when(outside, "rejected").otherwise(F.col("category")))
    return out


def pipeline_statistics(df: DataFrame) -> DataFrame:
    """(category, n, share): entries of each category and their percentage to two places."""
    total = df.groupBy("category").agg(F.count("*").alias("n"))
    return total.select("category", "n", F.round(100.0 * F.col("n") / F.sum("n").over(_all()), 2).alias("share"))


def _all():  # noqa: ANN202
    # over one row for each category, a handful
    return Window.partitionBy(F.lit(0))


def object_class_counts(df: DataFrame) -> DataFrame:
    """(object_class, n), case kept."""
    return df.select(F.explode(A.object_classes(F.col("attrs"))).alias("object_class")).groupBy("object_class").agg(F.count("*").alias("n"))


def rejection_counts(df: DataFrame) -> DataFrame:
    return df.where("rejection_reason is not null").groupBy("rejection_reason").agg(F.count("*").alias("n"))


def detect(df: DataFrame, key: str = "source", text: str = "line", number: str | None = "line_no", name_bonus: bool = False) -> DataFrame:
    """(key, dialect, confidence, scores): the dialect of each source from the patterns in its first lines.

    A source is rows of text; each is scored on its own, so a source of any size is never gathered. The best score must be `CONFIDENCE` of
    all and not the generic point, else the dialect is rfc. `name_bonus` gives the points that names containing their own dialect's name earn.
    """
    rows = df if number is None else df.where(F.col(number) < D.FIRST_LINES)
    hits = [F.max(F.when((F.col(text) if cased else F.lower(text)).rlike(pattern), weight).otherwise(0)).alias(name) for name, weight, pattern, cased in D.DETECTION]
    found = rows.groupBy(key).agg(*hits).withColumn("generic", F.lit(1))
    if name_bonus:
        found = found.withColumn("oid", F.col("oid") + D.NAME_BONUS)
    names = [*(d[0] for d in D.DETECTION), "generic"]
    total = reduce(lambda a, b: a + b, (F.col(n) for n in names))
    best = F.greatest(*(F.struct(F.col(n).alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)))
    share = best["score"] / total
    sure = (share >= D.CONFIDENCE) & (best["name"] != "generic")
    return found.select(key, F.when(sure, best["name"]).otherwise("rfc").alias("dialect"), F.round(share, 6).alias("confidence"), total.alias("scores"))


def sort_by_depth(df: DataFrame) -> DataFrame:
    """Parents before their children: by depth, then by the normal form of the name; a range sort."""
    return df.orderBy(depth(F.col("dn")), F.lower(norm_dn(F.col("dn"))))


def ranked(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """`df` with each row's place, from 1, in an order over all rows; ties are in any order.

    Rows are range-sorted, so that each task holds a range. The sorted rows are stored with their task's number and their place in it, each range
    reports its size (as many rows as tasks), and the sizes before a range are added.
    """
    sort = df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(sort)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    # one row for each task
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_range").alias("_own"), "first", earlier.alias("earlier"))
    placed = rows.join(F.broadcast(offsets), F.col("_range") == F.col("_own"))
    return placed.withColumn(name, F.col("_at") - F.col("first") + F.col("earlier") + 1).select(*df.columns, name)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, change): names that only one side has, and entries whose attributes differ; joined by the name's normal form."""
    flat = lambda df, s: df.select(F.lower(norm_dn(F.col("dn"))).alias("key"), F.xxhash64(A.flat(A.sort_attributes(F.col("attrs")))).alias(s))
    both = flat(left, "a").join(flat(right, "b"), "key", "full")
    change = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "modify")
    return both.select("key", change.alias("change")).where("change is not null")


def convert(df: DataFrame, source: str, target: str, base: str = "") -> DataFrame:
    """Entries of one dialect as those of another: access rules from oid to oud, names and booleans, and the name of the schema entry, between oid and all others; the dialects are noted. Rules for subjects outside `base` are dropped."""
    source, target = D.resolve(source), D.resolve(target)
    if source == "oid" and target == "oud":
        df = rewrite_rules(df, base)
    attrs, dn = F.col("attrs"), F.col("dn")
    if source == "oid" and target != "oid":
        attrs, dn = A.booleans_to_rfc(A.rename(attrs, A.OID_TO_RFC)), F.replace(dn, F.lit("cn=subschemasubentry"), F.lit("cn=schema"))
    elif target == "oid" and source != "oid":
        attrs, dn = A.booleans_to_oid(A.rename(attrs, A.RFC_TO_OID)), F.replace(dn, F.lit("cn=schema"), F.lit("cn=subschemasubentry"))
    return df.withColumn("attrs", attrs).withColumn("dn", dn).withColumn("original_server_type", F.lit(source)).withColumn("server_type", F.lit(target))


def process(df: DataFrame, *, source: str | None = None, target: str | None = None, normalize_names: bool = True, normalize_attrs: bool = True, base: str = "") -> DataFrame:
    """The processing chain, in its fixed order: dialect, names, attributes. Entries without a valid name keep theirs and an `error`."""
    out = convert(df, source, target, base) if source and target else df
    if normalize_names:
        bad = ~is_valid_dn(F.col("dn"))
        out = out.withColumn("error", F.when(bad, "invalid dn")).withColumn("dn", F.when(bad, F.col("dn")).otherwise(norm_dn(F.col("dn"))))
    return out.withColumn("attrs", A.normalize(F.col("attrs"))) if normalize_attrs else out


def move_base(df: DataFrame, source: str, target: str) -> DataFrame:
    """Names, and names inside name-valued attributes, from one base to another."""
    return df.withColumn("dn", rebase(F.col("dn"), source, target)).withColumn("attrs", A.rebase_values(F.col("attrs"), source, target))
