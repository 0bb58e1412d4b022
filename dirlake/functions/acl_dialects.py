"""Access rules of each dialect in one shape, and written back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirlake.functions.acl import parse_aci
from dirlake.functions.dn import strip

#: Letters of rights and what they grant, and access words from weak to strong.
RIGHTS = {"B": "search", "C": "compare", "D": "delete", "R": "read", "W": "write", "A": "add"}
LEVELS = ("none", "auth", "compare", "search", "read", "write", "manage")
SHAPE = "struct<name: string, target: string, target_attrs: array<string>, subject_type: string, subject: string, permissions: array<string>>"


def _content(line: Column) -> Column:
    """A rule without its attribute name and index."""
    bare = F.regexp_replace(strip(line), r"^(?i)(?:aci|acl|olcAccess|access|orclaci|orclentrylevelaci|ibm-filterAclEntry|aclEntry|aclRights):+\s*", "")
    return strip(F.regexp_replace(bare, r"^\{\d+\}", ""))


def _shape(name: Column, target: Column, attrs: Column, kind: Column, subject: Column, permissions: Column) -> Column:
    return F.struct(name.alias("name"), target.alias("target"), attrs.alias("target_attrs"), kind.alias("subject_type"), subject.alias("subject"), permissions.alias("permissions")).cast(SHAPE)


def _none() -> Column:
    return F.array().cast("array<string>")


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\s*,\s*"), strip), lambda x: x != "")


def _aci(line: Column) -> Column:
    p = parse_aci(_content(line))
    first = F.get(F.filter(p["clauses"], lambda c: c["kind"] == "allow"), F.lit(0))
    kind = F.when(first["bind_value"].isin("self", "anyone", "all"), first["bind_value"]).when(first["bind_type"] == "groupdn", "group").when(first["bind_type"] == "userdn", "user").otherwise(first["bind_type"])
    return _shape(p["name"], F.coalesce(F.nullif(p["target"], F.lit("")), F.lit("*")), p["target_attrs"], kind, first["bind_value"], F.coalesce(first["permissions"], _none()))


def _oid(line: Column) -> Column:
    c = _content(line)
    who = F.regexp_extract(c, r'(?i)\bby\s+(group="[^"]*"|dn="[^"]*"|"[^"]*"|self|\*|superuser|\w+=\([^)]*\))', 1)
    kind = F.when(who == "*", "anyone").when(F.lower(who).isin("self", "superuser"), F.lower(who)).when(who.startswith('"') | who.startswith("dn="), "user").otherwise(F.lower(F.substring_index(who, "=", 1)))
    value = F.regexp_replace(F.regexp_replace(who, r"^\w+=", ""), r'[()"]', "")
    perms = F.regexp_extract(c, r'(?i)\bby\s+(?:group="[^"]*"|dn="[^"]*"|"[^"]*"|self|\*|superuser|\w+=\([^)]*\))[^(]*\(([^)]*)\)', 1)
    return _shape(F.lit("orclaci"), F.lower(F.regexp_extract(c, r"(?i)access\s+to\s+(entry|attr)", 1)), _words(F.regexp_extract(c, r"(?i)attr\s*!?=\s*\(([^)]*)\)", 1)), kind, value, F.transform(_words(perms), F.lower))


def _levels(word: Column) -> Column:
    """All permissions up to a level, of those that rules can grant."""
    steps = F.array(*(F.lit(x) for x in LEVELS[2:6]))
    at = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.lower(word)).cast("int")
    return F.when(at > 2, F.slice(steps, F.lit(1), F.least(at - 2, F.lit(4)))).otherwise(_none())


def _openldap(line: Column) -> Column:
    c = _content(line)
    what = strip(F.regexp_extract(c, r"(?i)^(?:access\s+)?to\s+(.+?)\s+by\s", 1))
    who, level = (F.regexp_extract(c, r"(?i)\bby\s+(\S+)\s+(\S+)", g) for g in (1, 2))
    attrs = _words(F.regexp_extract(what, r"(?i)attrs?=(\S+)", 1))
    return _shape(F.lit("access"), F.when(what == "", "*").otherwise(what), attrs, F.lit("who"), F.when(who == "", "*").otherwise(who), _levels(level))


def _novell(line: Column) -> Column:
    parts = F.filter(F.split(_content(line), "#"), lambda x: x != "")
    rights = F.get(parts, F.lit(2))
    has = F.filter(F.array(*(F.when(F.upper(rights).contains(k), F.lit(v)) for k, v in RIGHTS.items())), lambda x: x.isNotNull())
    bracketed = F.regexp_extract(rights, r"\[([A-Z]+)\]", 1)
    return _shape(F.lit("novell"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), _none(), F.lit("user"), F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")), F.when(bracketed == "", F.coalesce(has, _none())).otherwise(F.filter(F.array(*(F.when(bracketed.contains(k), F.lit(v)) for k, v in RIGHTS.items())), lambda x: x.isNotNull())))


def _tivoli(line: Column) -> Column:
    word = F.lower(F.regexp_extract(_content(line), r'(?i)access\s+"?(\w+)"?', 1))
    granted = F.when(word.isin("", "read"), F.array(F.lit("read"))).when(word == "write", F.array(F.lit("write"))).otherwise(_none())
    return _shape(F.lit("tivoli"), F.lit(""), _none(), F.lit("user"), F.lit(""), granted)


def _sddl(line: Column) -> Column:
    c = strip(F.regexp_replace(strip(line), r"^(?i)nTSecurityDescriptor:+\s*", ""))
    raw = F.try_to_binary(c, F.lit("base64"))
    wide = F.decode(raw, "UTF-16LE")
    coded = strip(line).rlike(r"^\w+::") & raw.isNotNull()
    return _shape(F.lit("nTSecurityDescriptor"), F.lit("*"), _none(), F.lit("sddl"), F.when(coded, strip(wide)).otherwise(c), _none())


_PARSERS = {"oid": _oid, "openldap": _openldap, "openldap1": _openldap, "openldap2": _openldap, "novell": _novell, "ibm_tivoli": _tivoli, "ad": _sddl}


def parse_acl(line: Column, dialect: str) -> Column:
    """A rule as (name, target, target_attrs, subject_type, subject, permissions); the dialects that write ACIs share one parser. A null gives a null."""
    return F.when(line.isNotNull(), _PARSERS.get(dialect, _aci)(line))


def parse_acl_by(line: Column, dialect: Column) -> Column:
    """A rule as `parse_acl` reads it, with the dialect in a column; one that is not known is read as an ACI."""
    parsers: dict = {}
    for name, parser in _PARSERS.items():
        parsers.setdefault(parser, []).append(name)
    out = F.when(line.isNull(), None)
    for parser, names in parsers.items():
        out = out.when(dialect.isin(*names), parser(line))
    return out.otherwise(_aci(line))


def write_acl(a: Column, dialect: str) -> Column:
    """A rule of that shape in a dialect's own words."""
    perms = a["permissions"]
    if dialect in ("openldap", "openldap1", "openldap2"):
        strongest = reduce(lambda c, p: F.when(F.array_contains(perms, p), p).otherwise(c), LEVELS[2:6], F.lit("none"))
        return F.concat(F.lit("to "), a["target"], F.lit(" by "), a["subject"], F.lit(" "), strongest)
    if dialect == "novell":
        letters = F.concat(*(F.when(F.array_contains(perms, v), k).otherwise("") for k, v in RIGHTS.items()))
        return F.concat(a["target"], F.lit("#"), a["subject"], F.lit("#["), letters, F.lit("]"))
    if dialect == "ibm_tivoli":
        return F.concat(F.lit('access "'), F.when(F.array_contains(perms, "write"), "write").otherwise("read"), F.lit('"'))
    if dialect == "ad":
        return F.concat(F.lit("nTSecurityDescriptor: "), a["subject"])
    if dialect == "oid":
        who = F.when(a["subject_type"] == "anyone", "*").when(a["subject_type"].isin("self", "superuser"), a["subject_type"]).when(a["subject_type"] == "user", F.concat(F.lit('"'), a["subject"], F.lit('"'))).when(a["subject_type"] == "group", F.concat(F.lit('group="'), a["subject"], F.lit('"'))).otherwise(F.concat(a["subject_type"], F.lit("=("), a["subject"], F.lit(")")))
        what = F.when(F.size(a["target_attrs"]) > 0, F.concat(F.lit("attr=("), F.array_join(a["target_attrs"], ","), F.lit(")"))).otherwise("entry")
        return F.concat(F.lit("access to "), what, F.lit(" by "), who, F.lit(" ("), F.array_join(perms, ","), F.lit(")"))
    bind = F.when(a["subject_type"] == "group", "groupdn").when(a["subject_type"].isin("user", "self", "anyone", "all"), "userdn").otherwise(a["subject_type"])
    attrs = F.when(F.size(a["target_attrs"]) > 0, F.array_join(a["target_attrs"], "||")).otherwise("*")
    # a name in an ACI has no quotes and is bounded in length
    name = F.substring(F.regexp_replace(a["name"], r'["\x00-\x1F]', " "), 1, 128)
    return F.concat(F.lit('(targetattr="'), attrs, F.lit('")(version 3.0; acl "'), name, F.lit('"; allow ('), F.array_join(perms, ", "), F.lit(") "), bind, F.lit('="ldap:///'), a["subject"], F.lit('";)'))
