"""Rules for entries as columns: each gives an array of violations, empty for a sound entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake import dialects as D
from dirlake.functions import attrs as A
from dirlake.functions.dn import COMPONENT, strip

_NONE = "array<string>"
#: Fixed values.
NAME = r"^[a-zA-Z][a-zA-Z0-9-]*$"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF]"
MOST_NAME, MOST_DESCRIPTOR, MOST_VALUE = 127, 64, 4096


def _none() -> Column:
    return F.array().cast(_NONE)


def _if(test: Column, message: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(message)).otherwise(_none())


def attribute_name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME) & (F.length(name) <= MOST_NAME), F.lit(False))


def descriptor_ok(name: Column) -> Column:
    return F.coalesce(strip(name).rlike(rf"^[a-zA-Z0-9-]{{1,{MOST_DESCRIPTOR}}}$"), F.lit(False))


def value_ok(value: Column) -> Column:
    return F.coalesce(F.length(value) <= MOST_VALUE, F.lit(False))


def numeric_oid_ok(oid: Column) -> Column:
    return F.coalesce(oid.rlike(r"^\d+(\.\d+)*$"), F.lit(False))


def dn_violations(dn: Column) -> Column:
    """One for an empty name, else one for each naive component that is not `type=value`."""
    parts = F.filter(F.transform(F.split(dn, ","), strip), lambda p: p != "")
    numbered = F.transform(parts, lambda p, i: F.when(~p.rlike(COMPONENT), F.concat(F.lit("RFC 4514 § 2.3: Component "), i.cast("string"), F.lit(" '"), p, F.lit("' invalid format"))))
    return F.when(F.coalesce(strip(dn), F.lit("")) == "", F.array(F.lit("RFC 2849 § 2: DN is required (empty or whitespace DN)"))).when(F.size(parts) == 0, F.array(F.lit("RFC 4514 § 2.4: DN is empty (no RDN components)"))).otherwise(F.filter(numbered, lambda v: v.isNotNull()))


def attribute_violations(attrs: Column) -> Column:
    """Bad base names, and every option of a name."""
    # each option counts: the reference semantics ask for a `;` that the split has taken away
    def one(a: Column) -> Column:
        parts = F.split(a["name"], ";")
        base = parts[0]
        options = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), strip), lambda o: o != "")
        wrong = lambda o: F.concat(F.lit("RFC 4512 § 2.5: option '"), o, F.when(o.rlike(r"^[a-zA-Z]"), F.lit("' has invalid characters")).otherwise(F.lit("' must start with letter")))
        named = _if(~base.rlike(NAME), F.concat(F.lit("RFC 4512 § 2.5: '"), base, F.when(base.rlike(r"^[a-zA-Z]"), F.lit("' has invalid characters")).otherwise(F.lit("' must start with letter"))))
        return F.concat(named, F.transform(options, wrong))

    return F.flatten(F.transform(attrs, one))


def binary_violations(attrs: Column) -> Column:
    """Attributes with a control or Latin-1 high character in a value and no binary option."""
    bad = F.filter(attrs, lambda a: ~F.lower(a["name"]).contains(";binary") & F.exists(a["values"], lambda v: v["value"].rlike(CONTROL)))
    return F.transform(bad, lambda a: F.concat(F.lit("RFC 2849 § 5.2: '"), a["name"], F.lit("' may need ';binary' option")))


def _naming(dn: Column) -> Column:
    first = strip(F.substring_index(dn, ",", 1))
    return F.when(first.contains("="), F.lower(strip(F.substring_index(first, "=", 1))))


def _schema_dn(dn: Column) -> Column:
    low = F.lower(dn)
    test = F.lit(False)
    for marker in D.SCHEMA_DNS:
        test = test | low.startswith(marker)
    return test


def rfc_violations(dn: Column, attrs: Column, changetype: Column) -> Column:
    """All violations of an entry, in the order of the rules."""
    content = changetype.isNull()
    some = F.size(attrs) > 0
    naming = _naming(dn)
    return F.concat(
        dn_violations(dn),
        _if(content & ~some, F.lit("RFC 2849 § 2: Entry must have at least one attribute (empty)")),
        attribute_violations(attrs),
        binary_violations(attrs),
        _if(~content & ~F.lower(changetype).isin("add", "delete", "modify", "moddn", "modrdn"), F.concat(F.lit("RFC 2849 § 5.7: changetype '"), changetype, F.lit("' invalid"))),
        _if(content & some & naming.isNotNull() & ~F.array_contains(A.lower_names(attrs), naming), F.concat(F.lit("RFC 4512 § 2.3: Entry SHOULD have Naming attribute '"), naming, F.lit("'"))),
        _if(content & some & ~_schema_dn(dn) & ~A.has_any(attrs, ["objectClass"]), F.concat(F.lit("RFC 4512 § 2.4.1: Entry SHOULD have objectClass (DN: "), dn, F.lit(")"))),
    )


def requirements(dn: Column, attrs: Column) -> dict[str, Column]:
    """What each rule that a server may ask for finds."""
    naming = _naming(dn)
    bad = F.filter(attrs, lambda a: ~F.lower(a["name"]).contains(";binary") & F.exists(a["values"], lambda v: v["value"].rlike(r"[^\x20-\x7E]")))
    return {
        "binary": F.transform(bad, lambda a: F.concat(F.lit("Server requires ';binary' option for '"), a["name"], F.lit("'"))),
        "naming": _if(naming.isNotNull() & (F.size(attrs) > 0) & ~F.array_contains(A.lower_names(attrs), naming), F.concat(F.lit("Server requires naming attribute '"), naming, F.lit("'"))),
        "objectclass": _if(~A.has_any(attrs, ["objectClass"]) & ~_schema_dn(dn), F.lit("Server requires objectClass attribute")),
    }


def server_violations(dn: Column, attrs: Column, dialect: str) -> Column:
    """What the dialect's own rules find."""
    out = [found for rule, found in requirements(dn, attrs).items() if rule in D.RULES.get(dialect, ())]
    return F.concat(*out) if out else _none()


def roll_up(df: DataFrame, violations: str = "violations", most: int = 100) -> DataFrame:
    """One row (total, valid, invalid, success_rate, errors): counts, the percentage to two places (100 without rows), and the first `most` errors by text, a report's limit."""
    counts = df.agg(F.count("*").alias("total"), F.count_if(F.size(violations) == 0).alias("valid"))
    errors = df.select(F.explode(violations).alias("e")).distinct().orderBy("e").limit(most).agg(F.array_sort(F.collect_list("e")).alias("errors"))
    rate = F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("valid") / F.col("total"), 2))
    return counts.crossJoin(errors).select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), rate.alias("success_rate"), "errors")
