"""Who may do what: access control instructions with nested bind rules, decided for many requests by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.functions import acl
from dirlake.functions import bind_rules as B
from dirlake.functions.dn import ancestors
from dirlake.storage import stored

#: One clause of an instruction: its kind, permissions, and its bind rule.
_CLAUSE = r"(?is)\b(allow|deny)\s*\(([^)]*)\)\s*((?:[^;\"]|\"[^\"]*\")*);"


def clauses(rules: DataFrame, dn: str = "dn", aci: str = "aci") -> DataFrame:
    """(clause, base, name, kind, permissions, steps, error, target, scope): a row for each clause of the instructions (dn, aci), its bind rule in postfix.

    `base` is the entry that bears the instruction, `target` its target in comparable form (null without one). A rule that cannot be read has an error and grants nothing.
    """
    own = rules.where(F.col(aci).isNotNull()).select(B.key_of(F.col(dn)).alias("base"), acl.parse_aci(F.col(aci)).alias("a"), F.regexp_extract_all(aci, F.lit(_CLAUSE), F.lit(0)).alias("texts"))
    target = F.nullif(F.regexp_replace("a.target", r"(?i)^ldaps?:///", ""), F.lit(""))
    each = own.select("base", "a.name", B.pattern_of(target).alias("target"), F.nullif(F.lower("a.scope"), F.lit("")).alias("scope"), F.explode("texts").alias("text"))
    part = lambda k: F.regexp_extract("text", _CLAUSE, k)
    listed = F.filter(F.transform(F.split(part(2), ","), lambda p: F.lower(F.btrim(p))), lambda p: p != "")
    parsed = each.select("base", "name", "target", "scope", F.lower(part(1)).alias("kind"), listed.alias("permissions"), B.parse(part(3)).alias("p"))
    return parsed.select(F.monotonically_increasing_id().alias("clause"), "base", "name", "kind", "permissions", "p.steps", "p.error", "target", "scope")


def applicable(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, user, entry, clause, name, kind, steps) of the clauses that concern a request (request_id, user, entry, permission).

    A rule reaches the entry that bears it and what is below, as its scope says; so an entry's ancestors are joined with the rules' bases. Targets without
    a macro are bases of their own: the entry has to be the target or below it. `*` in a target stands for any text.
    """
    entry = B.key_of(F.col("entry"))
    asked = requests.select("request_id", B.key_of(F.col("user")).alias("user"), entry.alias("entry"), F.lower("permission").alias("permission"))
    above = asked.withColumn("base", F.explode(F.concat(F.array("entry"), F.coalesce(ancestors(F.col("entry")), F.array().cast("array<string>")), F.array(F.lit("")))))
    met = above.join(rules.where("error is null"), "base")
    met = met.where(F.arrays_overlap("permissions", F.array(F.col("permission"), F.lit("all"))))
    deep = F.when(F.col("scope").isin("base", "baseobject"), F.col("entry") == F.col("base")).when(F.col("scope") == "onelevel", F.get(ancestors(F.col("entry")), F.lit(0)) == F.col("base")).when(F.col("scope") == "subordinate", F.col("entry") != F.col("base"))
    macro = F.contains("target", F.lit(B.MACRO))
    dn = B.captured(F.col("target"), F.col("entry"))
    like = _like(F.col("entry"), F.concat(F.lit("*"), F.col("target")))
    plain = (F.col("entry") == F.col("target")) | F.endswith("entry", F.concat(F.lit(","), F.col("target"))) | (F.contains("target", F.lit("*")) & like)
    aimed = F.col("target").isNull() | F.when(macro, dn.isNotNull()).otherwise(plain)
    met = met.where(F.coalesce(deep, F.lit(True)) & aimed)
    return met.select("request_id", "user", "entry", "clause", "name", "kind", B.expanded(F.col("steps"), dn).alias("steps"))


def _like(name: Column, pattern: Column) -> Column:
    """Whether a name matches a pattern, in which only `*` means something."""
    plain = pattern
    for c in ("\\", "%", "_"):
        plain = F.replace(plain, F.lit(c), F.lit("\\" + c))
    return F.like(name, F.replace(plain, F.lit("*"), F.lit("%")))


def _userdn(value: Column, user: Column, entry: Column) -> Column:
    """Whether a `userdn` alternative means the user; an empty user is anonymous."""
    known = user != ""
    out = F.when(value == "anyone", True).when(value == "all", known).when(value == "self", known & (user == entry)).when(value == "parent", known & (F.get(ancestors(entry), F.lit(0)) == user))
    return out.when(F.contains(value, F.lit("*")), known & _like(user, value)).otherwise(known & (user == value))


def decide(requests: DataFrame, rules: DataFrame, members: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(request_id, granted, decided_by) of every request (request_id, user, entry, permission): denied if any deny clause holds, else granted if any allow clause does, else denied.

    `rules` are `clauses`; `members` (group, member) has every member of a group, nested ones resolved; `values` (entry, attr, value) the names that entries hold, for `userattr`.
    Terms are decided apart from their expressions: those on groups and attributes by joins on (group, member) and (entry, attr, value), then each expression is evaluated over the
    positions of its terms that hold. `decided_by` is the first name, by text, of the clauses that decide; null where none does. A null user or an empty one is anonymous.
    """
    met = stored(applicable(requests.withColumn("user", F.coalesce("user", F.lit(""))), stored(rules)))
    terms = met.select("request_id", "clause", "user", "entry", F.posexplode("steps").alias("at", "s")).where("s.op is null")
    terms = terms.select("request_id", "clause", "user", "entry", "at", "s.key", F.explode("s.values").alias("value"))
    terms = terms.withColumn("value", F.when(F.col("key") == "userattr", F.lower("value")).otherwise(B.key_of(F.col("value"))))
    direct = terms.where((F.col("key") == "userdn") & _userdn(F.col("value"), F.col("user"), F.col("entry")))
    grouped = members.select(B.key_of(F.col("group")).alias("value"), B.key_of(F.col("member")).alias("user")).distinct()
    by_group = terms.where("key = 'groupdn'").join(grouped, ["value", "user"], "left_semi")
    hits = direct.select("request_id", "clause", "at").unionByName(by_group.select("request_id", "clause", "at"))
    if values is not None:
        held = values.select(B.key_of(F.col("entry")).alias("entry"), F.lower("attr").alias("attr"), B.key_of(F.col("value")).alias("name")).distinct()
        asked = terms.where("key = 'userattr'").withColumns({"attr": F.substring_index("value", "#", 1), "how": F.substring_index("value", "#", -1)})
        owned = asked.join(held, ["entry", "attr"])
        by_user = owned.where("how = 'userdn' and name = user and user <> ''")
        through = owned.where("how = 'groupdn'").drop("value").withColumnRenamed("name", "value").join(grouped, ["value", "user"], "left_semi")
        hits = hits.unionByName(by_user.select("request_id", "clause", "at")).unionByName(through.select("request_id", "clause", "at"))
    hits = hits.groupBy("request_id", "clause").agg(F.collect_set("at").alias("hits"))
    tried = met.join(hits, ["request_id", "clause"], "left").withColumn("holds", B.holds(F.col("steps"), F.coalesce("hits", F.array().cast("array<int>"))))
    mark = lambda kind: F.min(F.when(F.col("holds") & (F.col("kind") == kind), F.col("name")))
    found = tried.groupBy("request_id").agg(mark("deny").alias("deny"), mark("allow").alias("allow"))
    out = requests.select("request_id").join(found, "request_id", "left")
    return out.select("request_id", (F.col("deny").isNull() & F.col("allow").isNotNull()).alias("granted"), F.coalesce("deny", "allow").alias("decided_by"))
