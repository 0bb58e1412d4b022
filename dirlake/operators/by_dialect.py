"""Operators whose dialect is a column: entries of many dialects are detected, checked, categorised and their access rules read in one plan.

What a dialect asks for is a row of a rule table, joined by the dialect's name, so that rules can be read from files, added to and replaced without code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake import dialects as D
from dirlake.functions import acl_dialects as L
from dirlake.functions import attrs as A
from dirlake.functions.dn import is_under_base, is_valid_dn
from dirlake.functions.validate import requirements

#: `place` orders detection; names of attributes and classes count whatever their case. `checks` has further rules: `requires` or `forbids` an attribute, of entries of a class or, where that is null, of all.
RULES = (
    "dialect string, place int, dn_marks array<string>, prefixes array<string>, classes array<string>, attributes array<string>, requires array<string>, decisive array<string>, "
    "categories array<struct<name: string, classes: array<string>, attributes: array<string>>>, acl_attributes array<string>, checks array<struct<rule: string, attribute: string, object_class: string>>"
)
#: A rule table of this size at most goes to every task; a larger one is joined by a shuffle.
MOST_ROWS, MOST_BYTES = 4096, 8 << 20


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules of all known dialects, a row for each."""
    rows = []
    places = {d: k for k, d in enumerate(D.SIGNATURES)}
    for d in D.NAMES:
        sign = D.SIGNATURES.get(d, D.Signature())
        order, decisive, classes, acl = D.CATEGORIES.get(d, (D.CATEGORIES["rfc"][0], (), {}, ()))
        categories = [(c, [], list(acl)) if c == "acl" else (c, list(classes.get(c, ())), []) for c in order]
        rows.append((d, places.get(d, len(places)), list(sign.dn), list(sign.prefixes), list(sign.classes), list(sign.attributes), list(D.RULES.get(d, ())), list(decisive), categories, list(D.RULE_SIGNS.get(d, ((), ()))[0]), []))
    return spark.createDataFrame(rows, RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from JSON lines; fields that a line leaves out are null."""
    return spark.read.schema(RULES).json(path)


def injected(rules: DataFrame, more: DataFrame) -> DataFrame:
    """`rules` with the rows of `more`: a dialect's fields that are not null take the place of those it had, its checks are added to them; new dialects are added. Of rows of `more` that repeat a dialect, one counts."""
    new = more.dropDuplicates(["dialect"])
    names = [c for c in rules.columns if c != "dialect"]
    a, b = rules.select("dialect", F.struct(*names).alias("a")), new.select("dialect", F.struct(*names).alias("b"))
    both = a.join(b, "dialect", "full_outer")
    field = lambda c: F.concat(F.coalesce("a.checks", F.array()), F.coalesce("b.checks", F.array())) if c == "checks" else F.coalesce(f"b.{c}", f"a.{c}")
    return both.select("dialect", *(field(c).alias(c) for c in names))


def resolved(name: Column) -> Column:
    """The dialect of a name in any spelling, `rfc` for a null; an unknown name stays as it is, in lower case."""
    low = F.lower(F.btrim(F.coalesce(name, F.lit("rfc"))))
    known = F.create_map(*(F.lit(x) for pair in D.ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, low), low)


def detect_entries(entries: DataFrame, rules: DataFrame, name: str = "dialect") -> DataFrame:
    """`entries` with the first dialect, by `place`, one of whose signs (parts of the name, starts of attribute names, attributes, object classes) an entry bears, else rfc. An entry without name and attributes is rfc."""
    sign = F.struct("place", "dialect", *(F.transform(F.coalesce(c, F.array()), F.lower).alias(c) for c in ("dn_marks", "prefixes", "classes", "attributes")))
    signs = rules.agg(F.array_sort(F.collect_list(sign)).alias("signs"))
    out = entries.withColumns({"_signs": signs.scalar(), "_low": F.lower(F.coalesce("dn", F.lit(""))), "_names": F.coalesce(A.lower_names(F.col("attrs")), F.array()), "_classes": _classes(F.col("attrs"))})
    low, names, classes = F.col("_low"), F.col("_names"), F.col("_classes")
    bears = lambda s: F.exists(s["dn_marks"], low.contains) | F.exists(s["prefixes"], lambda p: F.exists(names, lambda n: F.startswith(n, p))) | F.arrays_overlap(s["attributes"], names) | F.arrays_overlap(s["classes"], classes)
    found = F.get(F.filter("_signs", lambda s: F.coalesce(bears(s), F.lit(False))), F.lit(0))
    return out.withColumn(name, F.coalesce(found["dialect"], F.lit("rfc"))).drop("_signs", "_low", "_names", "_classes")


def _classes(attrs: Column) -> Column:
    return F.coalesce(F.transform(A.object_classes(attrs), F.lower), F.array())


def with_rules(entries: DataFrame, rules: DataFrame, dialect: str = "dialect") -> DataFrame:
    """`entries` with a struct `rules`, that of the dialect in their column; null where the table has none.

    The table is measured: up to MOST_ROWS rows and MOST_BYTES bytes it is broadcast, beyond that the join is a shuffle, whose hot dialects adaptive execution splits.
    """
    one = rules.dropDuplicates(["dialect"]).select(F.col("dialect").alias("_of"), F.struct(*(c for c in rules.columns if c != "dialect")).alias("rules"))
    n, size = one.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json("rules"))), F.lit(0))).first()
    side = F.broadcast(one) if n <= MOST_ROWS and size <= MOST_BYTES else one
    return entries.join(side, resolved(F.col(dialect)) == F.col("_of"), "left").drop("_of")


def server_violations(dn: Column, attrs: Column, rules: Column) -> Column:
    """What the rules in a column find: those of `dirlake.functions.validate.server_violations` that `requires` names, then the failed `checks` in their order. No rules find nothing."""
    asked = F.coalesce(rules["requires"], F.array())
    names, classes = A.lower_names(attrs), _classes(attrs)
    concerns = lambda c: c["object_class"].isNull() | F.array_contains(classes, F.lower(c["object_class"]))
    fails = lambda c: F.when(c["rule"] == "requires", ~F.array_contains(names, F.lower(c["attribute"]))).when(c["rule"] == "forbids", F.array_contains(names, F.lower(c["attribute"])))
    failed = F.filter(F.coalesce(rules["checks"], F.array()), lambda c: F.coalesce(concerns(c) & fails(c), F.lit(False)))
    said = F.transform(failed, lambda c: F.concat(F.lit("Server "), c["rule"], F.lit(" attribute '"), c["attribute"], F.lit("'"), F.coalesce(F.concat(F.lit(" of class '"), c["object_class"], F.lit("'")), F.lit(""))))
    return F.concat(*(F.when(F.array_contains(asked, rule), found).otherwise(F.array().cast("array<string>")) for rule, found in requirements(dn, attrs).items()), said)


def category(attrs: Column, rules: Column) -> Column:
    """The category of an entry by the rules in a column: schema by its attributes, hierarchy by a decisive class, then the first category with one of its classes or attributes, else `rejected`."""
    names, classes = A.lower_names(attrs), _classes(attrs)
    has = lambda known, own: F.arrays_overlap(F.transform(F.coalesce(known, F.array()), F.lower), own)
    first = F.get(F.filter(rules["categories"], lambda c: F.coalesce(has(c["classes"], classes) | has(c["attributes"], names), F.lit(False))), F.lit(0))
    return F.when(A.is_schema(attrs), "schema").when(has(rules["decisive"], classes), "hierarchy").otherwise(F.coalesce(first["name"], F.lit("rejected")))


def categorize(entries: DataFrame, base: str | None = None) -> DataFrame:
    """Entries that carry `rules`, with `category` and `rejection_reason`, as `dirlake.operators.entries.categorize` gives them for one dialect."""
    valid = is_valid_dn(F.col("dn"))
    out = entries.withColumn("category", F.when(valid, category(F.col("attrs"), F.col("rules"))).otherwise("rejected"))
    out = out.withColumn("rejection_reason", F.when(~valid, "Invalid DN").when(F.col("category") == "rejected", "No category match"))
    if base is None:
        return out
    outside = F.col("category").isin(*D.BY_BASE) & ~is_under_base(F.col("dn"), F.lit(base))
    return out.withColumns({"rejection_reason": F.when(outside, F.lit(f"DN not under base DN: {base}")).otherwise(F.col("rejection_reason")), "category": F.when(outside, "rejected").otherwise(F.col("category"))})


def acl_entries(entries: DataFrame, dialect: str = "dialect") -> DataFrame:
    """(dn, dialect, attribute, pos, acl, parsed): the access rules of entries that carry `rules`, each read as its entry's dialect writes them."""
    known = F.transform(F.coalesce("rules.acl_attributes", F.array()), F.lower)
    own = F.filter("attrs", lambda a: F.array_contains(known, F.lower(F.substring_index(a["name"], ";", 1))))
    each = entries.select("dn", F.col(dialect).alias("dialect"), F.explode(own).alias("a")).select("dn", "dialect", F.col("a.name").alias("attribute"), F.posexplode("a.values.value").alias("pos", "acl"))
    return each.withColumn("parsed", L.parse_acl_by(F.col("acl"), resolved(F.col("dialect"))))
