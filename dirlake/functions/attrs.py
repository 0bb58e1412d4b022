"""Attributes of an entry: an array of (name, values) in written order, as column expressions.

A value is a struct (value, origin, raw). Names are looked up whatever their case and the first match wins, except where a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirlake.functions.dn import DN_VALUED, norm_dn, rebase, strip
from dirlake.model import ATTRS, VALUE

#: Attributes that hold access rules, by dialect, and those that mark schema entries.
ACL_ATTRS = {"rfc": ("aci", "acl", "olcAccess", "aclRights", "aclEntry"), "oid": ("orclaci", "orclentrylevelaci", "aci", "acl"), "oud": ("aci", "orclaci", "orclentrylevelaci"), "ad": ("nTSecurityDescriptor", "aci"), "generic": ("aci", "acl")}
SCHEMA_ATTRS = ("attributetypes", "objectclasses", "matchingrules", "matchingruleuse", "ldapsyntaxes")
#: Names and booleans that two dialects spell differently.
OID_TO_RFC = {"orclguid": "entryUUID", "orclaci": "aci", "orclentrylevelaci": "aci"}
RFC_TO_OID = {"entryuuid": "orclguid", "aci": "orclaci"}
OID_BOOLEANS = ("orclisenabled", "orclaccountlocked", "orclpwdmustchange", "orclpasswordverify", "orclisvisible", "orclsamlenable", "orclsslenable", "orcldasenableproductlogo", "orcldasenablesubscriberlogo", "orcldasshowproductlogo", "orcldasenablebranding", "orcldasisenabled", "orcldasismandatory", "orcldasispersonal", "orcldassearchable", "orcldasselfmodifiable", "orcldasviewable", "pwdlockout", "pwdmustchange", "pwdallowuserchange")


def plain_value(c: Column) -> Column:
    return F.struct(c.alias("value"), F.lit("plain").alias("origin"), F.lit(None).cast("string").alias("raw"))


def attr(name: str, *values: Column) -> Column:
    """One attribute of single plain values; an array column gives several."""
    return F.struct(F.lit(name).alias("name"), F.transform(F.filter(F.array(*values), lambda v: v.isNotNull()), plain_value).alias("values"))


def attr_of_array(name: str, values: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.transform(values, plain_value).alias("values"))


def entry_attrs(*attributes: Column) -> Column:
    """Attributes of an entry; those without values are left out."""
    return F.filter(F.array(*attributes).cast(ATTRS), lambda a: F.size(a["values"]) > 0)


def names(attrs: Column) -> Column:
    return F.transform(attrs, lambda a: a["name"])


def lower_names(attrs: Column) -> Column:
    return F.transform(attrs, lambda a: F.lower(a["name"]))


def values_of(attrs: Column, name: str) -> Column:
    """The values of the first attribute of that name; an empty array without one."""
    found = F.get(F.filter(attrs, lambda a: F.lower(a["name"]) == name.lower()), F.lit(0))
    return F.coalesce(F.transform(found["values"], lambda v: v["value"]), F.array().cast("array<string>"))


def values_exact(attrs: Column, name: str) -> Column:
    """The values of the first attribute whose name is spelled exactly so; an empty array without one."""
    found = F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))
    return F.coalesce(F.transform(found["values"], lambda v: v["value"]), F.array().cast("array<string>"))


def unconverted(text: Column) -> Column:
    """Attributes that a conversion left in JSON: each member of an object as an attribute, in written order, a list as its values, anything else as its text; none where it is no object."""
    raw = F.from_json(F.when(F.ltrim(text).startswith("{"), text), "map<string, string>")
    listed = lambda v: F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>"))
    each = F.transform(F.map_entries(raw), lambda e: F.struct(e["key"].alias("name"), F.transform(F.coalesce(listed(e["value"]), F.array(e["value"])), plain_value).alias("values")))
    return F.coalesce(each.cast(ATTRS), F.array().cast(ATTRS))


def first_value(attrs: Column, name: str) -> Column:
    return F.get(values_of(attrs, name), F.lit(0))


def object_classes(attrs: Column) -> Column:
    return values_of(attrs, "objectClass")


def has_attribute(attrs: Column, name: str) -> Column:
    return F.size(values_of(attrs, name)) > 0


def has_object_class(attrs: Column, name: str) -> Column:
    """Case matters here."""
    return F.array_contains(object_classes(attrs), name)


def has_any(attrs: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(lower_names(attrs), F.array(*(F.lit(n.lower()) for n in wanted))) if wanted else F.lit(False)


def has_all(attrs: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*(F.lit(n.lower()) for n in wanted)), lower_names(attrs))) == 0 if wanted else F.lit(True)


def remove_attributes(attrs: Column, unwanted: Sequence[str]) -> Column:
    return F.filter(attrs, lambda a: ~F.lower(a["name"]).isin([n.lower() for n in unwanted]))


def remove_object_classes(attrs: Column, unwanted: Sequence[str]) -> Column:
    """objectClass without the unwanted values; the attribute goes if none is left."""
    low = [n.lower() for n in unwanted]
    own = lambda a: F.lower(a["name"]) == "objectclass"
    kept = F.transform(attrs, lambda a: F.when(own(a), F.struct(a["name"].alias("name"), F.filter(a["values"], lambda v: ~F.lower(v["value"]).isin(low)).alias("values"))).otherwise(a))
    return F.filter(kept, lambda a: ~own(a) | (F.size(a["values"]) > 0))


def _map_values(attrs: Column, change) -> Column:  # noqa: ANN001
    """Each attribute with `change(lower name, value text)` for its values; raw forms of changed values go."""
    # what changes is written once, since the expression may be long
    both = lambda a: F.transform(a["values"], lambda v: F.struct(change(F.lower(a["name"]), v["value"]).alias("new"), v.alias("old")))
    one = lambda a: F.transform(both(a), lambda p: F.struct(p["new"].alias("value"), p["old"]["origin"].alias("origin"), F.when(p["new"].eqNullSafe(p["old"]["value"]), p["old"]["raw"]).alias("raw")).cast(VALUE))
    return F.transform(attrs, lambda a: F.struct(a["name"].alias("name"), one(a).alias("values")))


def last_wins(attrs: Column) -> Column:
    """Of attributes with one name, the last one's values at the first one's place."""
    distinct = F.array_distinct(names(attrs))
    return F.transform(distinct, lambda n: F.element_at(F.filter(attrs, lambda a: a["name"] == n), -1))


def normalize(attrs: Column, fold_names: bool = True, trim: bool = True, drop_empty: bool = True) -> Column:
    """Names in lower case (the last of equal names wins), values trimmed, empty values and then empty attributes dropped."""
    out = attrs
    if fold_names:
        out = F.transform(out, lambda a: F.struct(F.lower(a["name"]).alias("name"), a["values"].alias("values")))
    if trim:
        out = _map_values(out, lambda _, v: strip(v))
    if drop_empty:
        out = F.filter(F.transform(out, lambda a: F.struct(a["name"].alias("name"), F.filter(a["values"], lambda v: v["value"] != "").alias("values"))), lambda a: F.size(a["values"]) > 0)
    return last_wins(out) if fold_names else out


def merge_names(attrs: Column) -> Column:
    """Attributes of one name, whatever its case, as one, values in written order; objectClass in its own spelling."""
    keys = F.array_distinct(lower_names(attrs))
    joined = lambda k: F.flatten(F.transform(F.filter(attrs, lambda a: F.lower(a["name"]) == k), lambda a: a["values"]))
    spelled = lambda k: F.when(k == "objectclass", F.lit("objectClass")).otherwise(F.filter(attrs, lambda a: F.lower(a["name"]) == k)[0]["name"])
    return F.transform(keys, lambda k: F.struct(spelled(k).alias("name"), joined(k).alias("values")))


def rename(attrs: Column, mapping: Mapping[str, str]) -> Column:
    """Names in lower case and mapped; of two with one target, the last one's values stay."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in (pair[0].lower(), pair[1])))
    named = lambda a: F.struct(F.coalesce(F.element_at(table, F.lower(a["name"])), F.lower(a["name"])).alias("name"), a["values"].alias("values"))
    return last_wins(F.transform(attrs, named))


def booleans_to_rfc(attrs: Column) -> Column:
    """0, 1 and any case of true and false of the known boolean attributes as TRUE or FALSE; anything else is FALSE."""
    return _map_values(attrs, lambda n, v: F.when(n.isin(*OID_BOOLEANS), F.when(F.lower(v).isin("1", "true"), F.lit("TRUE")).otherwise(F.lit("FALSE"))).otherwise(v))


def booleans_to_oid(attrs: Column) -> Column:
    return _map_values(attrs, lambda n, v: F.when(n.isin(*OID_BOOLEANS), F.when(F.lower(v).isin("1", "true"), F.lit("1")).otherwise(F.lit("0"))).otherwise(v))


def rebase_values(attrs: Column, source: str, target: str) -> Column:
    """Names inside the name-valued attributes moved from one base to another."""
    low = [n.lower() for n in DN_VALUED]
    return _map_values(attrs, lambda n, v: F.when(n.isin(*low) & norm_dn(v).isNotNull(), rebase(v, source, target)).otherwise(v))


def sort_attributes(attrs: Column) -> Column:
    """By name, whatever the case; objectClass first."""
    key = lambda a: F.struct((F.lower(a["name"]) != "objectclass").alias("rest"), F.lower(a["name"]).alias("low"), a["name"].alias("name"), a["values"].alias("values"))
    return F.transform(F.array_sort(F.transform(attrs, key)), lambda s: F.struct(s["name"].alias("name"), s["values"].alias("values")))


def is_acl_attribute(name: Column, server: str = "rfc") -> Column:
    return F.lower(name).isin([n.lower() for n in ACL_ATTRS.get(server, ACL_ATTRS["rfc"])])


def is_schema(attrs: Column) -> Column:
    return has_any(attrs, SCHEMA_ATTRS)


def flat(attrs: Column) -> Column:
    """The attributes as one text, `name=value|value;name=...`: a scalar to compare and report."""
    return F.array_join(F.transform(attrs, lambda a: F.concat(a["name"], F.lit("="), F.array_join(F.transform(a["values"], lambda v: v["value"]), "|"))), ";")
