"""Access rules: parsed, evaluated and translated between dialects."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from dirlake.functions.attrs import attr_of_array, plain_value
from dirlake.functions.dn import strip
from dirlake.model import ATTRS

#: Permissions of an access rule, and those that evaluation asks for.
PERMISSIONS = ("read", "write", "add", "delete", "search", "compare", "self_write", "proxy", "browse", "auth", "all", "none", "no_add", "no_delete", "no_proxy", "no_browse")
REQUIRED = ("read", "write", "delete", "add", "search", "compare")

#: What the permissions of one dialect are in the other, in the order of writing. None: not granted.
ENTRY_PERMS = {"all": "all", "browse": "read, search", "add": "add", "delete": "delete", "proxy": "proxy"}
ATTR_PERMS = {"all": "all", "read": "read", "search": "search", "write": "write", "selfwrite": "selfwrite", "compare": "compare"}
NEGATIONS = {"noread": "read", "nosearch": "search", "nowrite": "write", "noselfwrite": "selfwrite", "nocompare": "compare", "noadd": "add", "nodelete": "delete", "noproxy": "proxy", "nobrowse": "browse"}
ORDER = ("all", "read", "search", "write", "selfwrite", "compare", "add", "delete", "proxy")
#: Names under a base where a rule for anyone would reach the whole tree: the base itself, and what a site adds to it.
HIGH_LEVEL = ("",)


def parse_aci(aci: Column) -> Column:
    """A struct of an ACI: name, target_attrs, target, scope, filter, clauses (kind, permissions, bind type, bind value)."""
    clause = r"(?i)\b((?:allow|deny)\s*\([^)]*\)[^;]*);"
    clauses = F.transform(F.regexp_extract_all(aci, F.lit(clause), F.lit(1)), lambda c: F.struct(
        F.lower(F.regexp_extract(c, r"^(\w+)", 1)).alias("kind"),
        F.filter(F.transform(F.split(F.regexp_extract(c, r"\(([^)]*)\)", 1), ","), lambda p: F.lower(strip(p))), lambda p: p != "").alias("permissions"),
        F.lower(F.regexp_extract(c, r"\)\s*(\w+)\s*=", 1)).alias("bind_type"),
        F.regexp_replace(F.regexp_extract(c, r'\)\s*\w+\s*=\s*"([^"]*)"', 1), r"^ldap:///", "").alias("bind_value"),
    ))
    attrs = F.regexp_extract(aci, r'(?i)targetattr\s*!?=\s*"([^"]*)"', 1)
    return F.struct(
        F.regexp_extract(aci, r'(?i)acl\s+"([^"]*)"', 1).alias("name"),
        F.filter(F.transform(F.split(attrs, r"\|\|"), strip), lambda a: a != "").alias("target_attrs"), aci.rlike(r"(?i)targetattr\s*!=").alias("target_negated"),
        F.regexp_extract(aci, r'(?i)target\s*=\s*"([^"]*)"', 1).alias("target"), F.regexp_extract(aci, r'(?i)targetscope\s*=\s*"([^"]*)"', 1).alias("scope"),
        F.regexp_extract(aci, r'(?i)targetfilter\s*=\s*"([^"]*)"', 1).alias("filter"), clauses.alias("clauses"),
    )


def granted(aci: Column) -> Column:
    """The distinct permissions that an ACI's allow clauses grant, in their order."""
    clauses = F.filter(parse_aci(aci)["clauses"], lambda c: c["kind"] == "allow")
    return F.array_distinct(F.flatten(F.transform(clauses, lambda c: c["permissions"])))


def grants(aci: Column, required: list[str]) -> Column:
    """Whether one ACI allows all of `required`; `all` stands for each."""
    have = granted(aci)
    return F.array_contains(have, "all") | (F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), have)) == 0)


def evaluate(acls: DataFrame, key: str, required: list[str], aci: str = "aci", pos: str = "pos") -> DataFrame:
    """(key, granted, matched): the first rule of each key, by `pos`, that grants all required permissions. Rules are pre-aggregated, so keys of any number of rules are safe."""
    hit = grants(F.col(aci), [r for r in required if r in REQUIRED])
    return acls.groupBy(key).agg(F.max(hit).alias("granted"), F.min_by(F.when(hit, parse_aci(F.col(aci))["name"]), F.when(hit, F.col(pos))).alias("matched"))


def oid_permissions(tokens: Column) -> Column:
    """Permissions granted on entries when `browse` becomes read and search and `selfwrite` becomes write."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.when(t == "browse", F.array(F.lit("read"), F.lit("search"))).when(t == "selfwrite", F.array(F.lit("write"))).otherwise(F.array(t)))))


def oud_permissions(tokens: Column) -> Column:
    """The way back: read and search together become `browse`."""
    both = F.array_contains(tokens, "read") & F.array_contains(tokens, "search")
    return F.when(both, F.concat(F.array(F.lit("browse")), F.array_except(tokens, F.array(F.lit("read"), F.lit("search"))))).otherwise(tokens)


def _allowed(tokens: list[str], entry: bool) -> list[str]:
    """The ordered permissions of one by-clause in the new dialect; an unknown token is an error."""
    table, known = (ENTRY_PERMS if entry else ATTR_PERMS), set(ENTRY_PERMS) | set(ATTR_PERMS)
    universe = [p for p in table if p != "all"]
    low = [t for t in (t.strip().lower() for t in tokens) if t]
    removed = {NEGATIONS[t] for t in low if t in NEGATIONS}
    if unknown := [t for t in low if t != "none" and t not in NEGATIONS and t not in known]:
        raise ValueError(f"unknown permission: {unknown[0]}")
    wanted = [t for t in low if t in table]
    if "all" in wanted:
        if not removed:
            return ["all"]
        wanted = [p for p in universe if p not in removed] + [t for t in wanted if t != "all" and t not in removed]
    elif not wanted and removed and "none" not in low:
        wanted = [p for p in universe if p not in removed]
    new = {p.strip() for t in wanted for p in table[t].split(",")}
    return sorted(new, key=ORDER.index)


def _short(name: str) -> str | None:
    """The value of a name's first component."""
    first = name.split(",", 1)[0]
    return first.split("=", 1)[1].strip() if "=" in first else None


_SUBJECTS = (
    # pattern, bind type, bind value (a format of the match), kind
    (r'superuser', "userdn", "cn=Directory Manager", "superuser"),
    (r'group="([^"]+)"', "groupdn", "{0}", "group"),
    (r'dn="([^"]+)"', "userdn", "{0}", "user"),
    (r'"([^"]+)"', "userdn", "{0}", "user"),
    (r'self', "userdn", "self", "self"),
    (r'\*', "userdn", "anyone", "anyone"),
    (r'dnattr=\(?([^)\s]+)\)?', "userattr", "{0}#USERDN", "dnattr"),
    (r'groupattr=\(?([^)\s]+)\)?', "userattr", "{0}#GROUPDN", "groupattr"),
)


def translate_oid_rule(dn: str, rule: str, entry_level: bool = False, base: str = "", high_level: Sequence[str] = HIGH_LEVEL) -> tuple[str | None, list[str]]:
    """One OID access rule as an ACI, and notes on what was left out; no ACI if nothing is granted. `high_level` are starts of names that stand before the base, where a rule for anyone is dropped. A small helper for single rules."""
    import re

    text = rule.strip()
    head = re.match(r"(?i)access\s+to\s+(entry|attr\s*(!?=)\s*\(?([^)\s]+)\)?)\s*", text)
    if not head:
        return None, ["not an access rule"]
    entry = head[1].lower() == "entry"
    rest = text[head.end() :]
    wanted = ""
    if found := re.match(r"(?i)filter\s*=\s*(?=\()", rest):
        depth = 0
        for k, ch in enumerate(rest[found.end() :], found.end()):
            depth += (ch == "(") - (ch == ")")
            if not depth:
                wanted, rest = rest[found.end() : k + 1], rest[k + 1 :].strip()
                break
        else:
            return None, ["unbalanced filter"]
    joined = "*" if entry or head[3] == "*" else "||".join(a.strip() for a in head[3].split(","))
    target = f'(targetattr{"!=" if head[2] == "!=" else "="}"{joined}")' + (f'(targetfilter="{wanted}")' if wanted else "")
    notes: list[str] = []
    groups: dict[tuple[tuple[str, ...], str], list[str]] = {}
    anyone_stays, stopped, first = False, False, None
    high = {h + base.lower() for h in high_level} if base else set()
    at = re.sub(r"\s*,\s*", ",", dn.lower())
    for clause in re.findall(r"(?i)\bby\s+(.*?\([^()]*\))(?=\s+by\s|\s*$)", rest):
        for pattern, kind, form, name in _SUBJECTS:
            got = re.match(rf"(?i){pattern}", clause)
            if got:
                break
        else:
            first = first if first is not None else ""
            notes.append(f"no equivalent: {clause.split(' ')[0]}")
            continue
        value = re.sub(r"\s*=\s*", "=", re.sub(r"\s*,\s*", ",", form.format(*got.groups())))
        first = first if first is not None else (got[1] if got.groups() else form)
        tokens = clause[clause.rindex("(") + 1 : -1].split(",")
        if stopped:
            notes.append(f"after the end: {value}")
            continue
        if name == "anyone" and [t.strip().lower() for t in tokens] == ["none"]:
            stopped = True
            notes.append("default deny")
            continue
        if name == "anyone" and at in high:
            notes.append("anyone at a high-level container")
            continue
        if name in ("group", "user"):
            value = value.replace(".*", "*").replace(".+", "*").replace("\\.", ".").replace("\\,", ",")
            if base and not (value.lower() == base.lower() or value.lower().endswith("," + base.lower())):
                notes.append(f"out of scope: {value}")
                continue
        perms = _allowed(tokens, entry)
        if not perms:
            notes.append(f"nothing allowed: {value}")
            continue
        mode = re.search(r'(?i)bindmode\s*=\s*\(?"?(\w+)"?\)?', clause)
        bind = f'{kind}="{value}"' if kind == "userattr" else f'{kind}="ldap:///{value}"'
        extra = f' and authmethod="{mode[1]}"' if mode else ""
        groups.setdefault((tuple(perms), extra), []).append(bind + extra)
        anyone_stays |= name == "anyone"
    if not groups:
        return None, notes
    scope = '(targetscope="base")' if entry_level or anyone_stays else ""
    label = f"{_short(dn) or 'unknown'} {'Entry' if entry else 'Attrs'} by {_short(first or '') or first}"
    more = len({perms for perms, _ in groups}) - 1
    label += f" (+{more})" if more else ""
    allows = " ".join(f"allow ({', '.join(perms)}) {' or '.join(binds)};" for (perms, _), binds in groups.items())
    return f'{target}{scope}(version 3.0; acl "{label}"; {allows})', notes


def oid_to_oud(dn: Column, rule: Column, entry_level: Column | None = None, base: str = "") -> Column:
    """struct<aci, notes, error>: each OID access rule as an ACI. A token that no dialect knows is an error, never a partial rule."""

    @F.arrow_udf("struct<aci: string, notes: array<string>, error: string>")
    def translated(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, rules, levels in batches:
            out: list[Mapping] = []
            for d, r, level in zip(names.to_pylist(), rules.to_pylist(), levels.to_pylist(), strict=True):
                try:
                    aci, notes = translate_oid_rule(d or "", r or "", bool(level), base)
                    out.append({"aci": aci, "notes": notes, "error": None})
                except ValueError as e:
                    out.append({"aci": None, "notes": [], "error": str(e)})
            yield pa.array(out, pa.struct([("aci", pa.string()), ("notes", pa.list_(pa.string())), ("error", pa.string())]))

    return translated(dn, rule, F.lit(False) if entry_level is None else entry_level)


def distinct_rules(acls: DataFrame, key: str, aci: str = "aci", pos: str = "pos") -> DataFrame:
    """(key, aci, pos): rules that differ in more than blanks and case, the first spelling of each."""
    norm = F.lower(F.regexp_replace(F.col(aci), r"\s+", " "))
    return acls.groupBy(key, norm.alias("_n")).agg(F.min_by(aci, pos).alias(aci), F.min(pos).alias(pos)).drop("_n")


def rewrite_rules(df: DataFrame, base: str = "") -> DataFrame:
    """Entries (dn, attrs, ...) with their OID access rules as ACIs: rules of `orclaci`, `orclentrylevelaci`, and of `aci` where they begin with `access to`.

    ACIs that differ in more than blanks and case come once, after those that stood there already; a rule with an unknown token stays as it is.
    """
    is_rule = lambda a, v: F.lower(a["name"]).isin("orclaci", "orclentrylevelaci", "aci") & F.lower(F.ltrim(v["value"])).startswith("access to")
    attrs = F.col("attrs")
    old = F.flatten(F.transform(attrs, lambda a: F.transform(F.filter(a["values"], lambda v: is_rule(a, v)), lambda v: F.struct(F.lower(a["name"]).alias("name"), v["value"].alias("rule")))))

    name = max(["rules", *df.columns], key=len) + "_"
    kind = pa.list_(pa.struct([("aci", pa.string()), ("rule", pa.string()), ("name", pa.string())]))

    def translate(d: str, own: list[dict]) -> list[dict]:
        done: dict[str, dict] = {}
        for r in own:
            try:
                aci, _ = translate_oid_rule(d, r["rule"], r["name"] == "orclentrylevelaci", base)
                got = {"aci": aci, "rule": None, "name": None}
            except ValueError:
                got = {"aci": None, "rule": r["rule"], "name": r["name"]}
            if got["aci"] or got["rule"]:
                done.setdefault(" ".join((got["aci"] or got["rule"]).lower().split()), got)
        return list(done.values())

    def translated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = batch.column(name).to_pylist()
            names = batch.column("dn").to_pylist()
            done = pa.array([translate(d or "", own) if own else [] for d, own in zip(names, rules, strict=True)], kind)
            yield pa.record_batch([*batch.columns[:-1], done], names=batch.schema.names)

    marked = df.withColumn(name, F.coalesce(old, F.array().cast("array<struct<name: string, rule: string>>")))
    df = marked.mapInArrow(translated, StructType([*df.schema.fields, StructField(name, ArrayType(StructType([StructField(c, StringType()) for c in ("aci", "rule", "name")])))]))
    new = F.col(name)
    kept = F.filter(F.transform(attrs, lambda a: F.struct(a["name"].alias("name"), F.filter(a["values"], lambda v: ~is_rule(a, v)).alias("values"))), lambda a: F.size(a["values"]) > 0)
    there = F.flatten(F.transform(F.filter(kept, lambda a: F.lower(a["name"]) == "aci"), lambda a: F.transform(a["values"], lambda v: v["value"])))
    acis = F.array_distinct(F.concat(there, F.transform(F.filter(new, lambda r: r["aci"].isNotNull()), lambda r: r["aci"])))
    bad = F.transform(F.filter(new, lambda r: r["rule"].isNotNull()), lambda r: F.struct(r["name"].alias("name"), F.array(plain_value(r["rule"])).alias("values")))
    rest = F.filter(kept, lambda a: F.lower(a["name"]) != "aci")
    done = F.when(F.size(old) == 0, attrs.cast(ATTRS)).otherwise(F.concat(rest.cast(ATTRS), F.when(F.size(acis) > 0, F.array(attr_of_array("aci", acis))).otherwise(F.array()).cast(ATTRS), bad.cast(ATTRS)))
    return df.withColumn("attrs", done).drop(name)
