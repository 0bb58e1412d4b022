"""What dialects do in their own way: lenient reading, signs of definitions and rules, rewriting on the way in and out, notes and reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake import dialects as D
from dirlake.functions import acl
from dirlake.functions import attrs as A
from dirlake.functions import dn as N
from dirlake.functions import lexer4512 as X
from dirlake.functions import schema4512 as S
from dirlake.model import ATTRS
from dirlake.operators import entries as E

# --- lenient reading ---------------------------------------------------------------------------------------------------


def relaxed(df: DataFrame) -> DataFrame:
    """Parsed entries as a lenient reader takes them: any name that is there is accepted, and what the strict reader found stays in `strict_error`."""
    lenient = F.when(F.coalesce(F.col("dn"), F.lit("")) == "", F.col("error"))
    return df.withColumn("strict_error", F.col("error")).withColumn("error", lenient).withColumn("server_type", F.when(F.col("strict_error").isNull(), "rfc").otherwise("relaxed"))


#: The productions of RFC 4512 for numbers and keystrings; lenient readers see dots and underscores in keystrings too.
NUMBER, KEYSTRING = "[0-9]+", "[A-Za-z][A-Za-z0-9._-]*"


def relaxed_oid(definition: Column) -> Column:
    """The identifier of a definition, however it is written: a number behind a bracket, else a dotted number anywhere, else the word behind the first bracket."""
    found = lambda pattern, group: F.nullif(F.regexp_extract(definition, pattern, group), F.lit(""))
    behind = r"\(\s*"
    return F.coalesce(found(f"{behind}({NUMBER}(?:[.]{NUMBER})*)", 1), found(f"{NUMBER}(?:[.]{NUMBER})+", 0), found(f"{behind}({KEYSTRING})", 1))


def schema_entry(dn: Column, attrs: Column, strict: bool = True) -> Column:
    """Whether an entry holds schema: by its attributes and its name, or leniently by any of these or its object classes."""
    low, classes = F.lower(dn), F.transform(A.object_classes(attrs), F.lower)
    named = reduce(lambda a, b: a | b, (low.contains(m) for m in D.SCHEMA_DNS))
    marked = F.arrays_overlap(classes, F.array(*map(F.lit, D.SCHEMA_CLASSES)))
    return F.coalesce(A.is_schema(attrs) & named if strict else A.is_schema(attrs) | named | marked, F.lit(False))


# --- signs ---------------------------------------------------------------------------------------------------------------


def _any_starts(names: Column, prefix: str) -> Column:
    return F.exists(names, lambda n: n.startswith(prefix))


def definition_of(definition: Column, dialect: str) -> Column:
    """Whether a schema definition is one of a dialect's own: by its numbers or by the start of one of its names."""
    sign = D.SIGNATURES.get(dialect, D.Signature())
    low = F.transform(S.names_of(definition), F.lower)
    tests = [definition.rlike(D.OID_SIGNS[dialect])] if dialect in D.OID_SIGNS else []
    tests += [_any_starts(low, p) for p in sign.prefixes]
    if sign.attributes:
        tests.append(F.arrays_overlap(low, F.array(*map(F.lit, sign.attributes))))
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def rule_of(line: Column, dialect: str) -> Column:
    """Whether an access rule's line bears the dialect's attribute or begins as the dialect's rules do."""
    name = F.lower(N.strip(F.substring_index(line, ":", 1)))
    body = F.lower(N.strip(line))
    return F.coalesce((line.contains(":") & name.isin(*(n.lower() for n in D.RULE_SIGNS.get(dialect, ((), ()))[0]))) | reduce(lambda a, b: a | b, (body.startswith(p) for p in D.RULE_SIGNS.get(dialect, ((), ()))[1]), F.lit(False)), F.lit(False))


def supported() -> dict[str, dict[str, bool]]:
    """What can be converted of each dialect's own: definitions and entries of all that have a name of their own, access rules of those whose rules have an attribute."""
    own = {d: d != "generic" for d in D.NAMES}
    return {d: {"attribute": own[d], "objectclass": own[d], "acl": bool(D.RULE_SIGNS.get(d, ((), ()))[0]), "entry": own[d]} for d in D.NAMES}


def supported_table(spark: SparkSession) -> DataFrame:
    """(dialect, kind, supported)."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(d).alias("dialect"), F.lit(k).alias("kind"), F.lit(v).alias("supported")) for d, kinds in supported().items() for k, v in kinds.items()))).alias("x")).select("x.*")


def supported_in(entries: DataFrame, dialect: str = "dialect") -> DataFrame:
    """(dialect, entries, kind, supported) of the dialects that a table's entries have: what of them can be converted. A dialect that is not known supports nothing; the table of all dialects has a few dozen rows."""
    found = entries.groupBy(F.col(dialect).alias("dialect")).agg(F.count("*").alias("entries"))
    kinds = found.withColumn("kind", F.explode(F.array(*map(F.lit, ("attribute", "objectclass", "acl", "entry")))))
    known = supported_table(entries.sparkSession)
    return kinds.join(F.broadcast(known), ["dialect", "kind"], "left").select("dialect", "entries", "kind", F.coalesce("supported", F.lit(False)).alias("supported"))


# --- schema texts --------------------------------------------------------------------------------------------------------


def without_keyword(definition: Column) -> Column:
    """A definition without the keyword that configuration files put before it."""
    return N.strip(F.regexp_replace(definition, r"(?i)^\s*(?:attributetype|objectclass)\s+", ""))


def with_keyword(definition: Column) -> Column:
    """An attribute type or object class in the order and with the keyword of configuration files, with all fields that they can hold; `lost_with_keyword` names those that they cannot."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    some = lambda c, *parts: F.when(c.isNotNull(), F.concat(*parts))
    word = lambda keyword, c: some(c, F.lit(keyword + " "), c)
    flag = lambda keyword: F.when(_bare(definition).rlike(rf"\b{keyword}\b"), F.lit(keyword))
    a, o, names = S.attribute_type(definition), S.object_class(definition), S.names_of(definition)
    listed = lambda keyword, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{keyword} ( "), F.array_join(c, " $ "), F.lit(" )")))
    named = F.when(F.size(names) > 1, F.concat(F.lit("NAME ( "), F.array_join(F.transform(names, quoted), " "), F.lit(" )"))).otherwise(some(a["name"], F.lit("NAME "), quoted(a["name"])))
    syntax = some(a["syntax"], F.lit("SYNTAX "), a["syntax"], F.coalesce(F.concat(F.lit("{"), a["length"].cast("string"), F.lit("}")), F.lit("")))
    desc = some(a["desc"], F.lit("DESC "), quoted(a["desc"]))
    attribute = F.concat_ws(
        " ", F.lit("attributetype ("), a["oid"], named, desc, flag("OBSOLETE"), word("SUP", a["sup"]), syntax, word("EQUALITY", a["equality"]), word("ORDERING", a["ordering"]), word("SUBSTR", a["substr"]),
        flag("SINGLE-VALUE"), flag("COLLECTIVE"), flag("NO-USER-MODIFICATION"), word("USAGE", a["usage"]), F.lit(")"),
    )
    above = S.superiors(definition)
    sup = F.when(F.size(above) > 1, listed("SUP", above)).otherwise(word("SUP", o["sup"]))
    cls = F.concat_ws(" ", F.lit("objectclass ("), o["oid"], named, desc, flag("OBSOLETE"), sup, o["kind"], listed("MUST", o["must"]), listed("MAY", o["may"]), F.lit(")"))
    return F.when(S.kind_of(definition) == "objectclass", cls).otherwise(attribute)


def lost_with_keyword(definition: Column) -> Column:
    """The fields of a definition that configuration files cannot hold: its extensions, in written order."""
    return F.transform(extensions(definition), lambda x: x["name"])


def _bare(definition: Column) -> Column:
    """A definition without what stands in quotes."""
    return F.regexp_replace(definition, r"'[^']*'", "''")


def extensions(definition: Column) -> Column:
    """(name, value) of the X- extensions, in written order."""
    found = F.regexp_extract_all(definition, F.lit(r"\b(X-[A-Za-z0-9_-]+\s+'[^']*')"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("name"), F.regexp_extract(x, r"'([^']*)'", 1).alias("value")))


def formatting(definition: Column) -> Column:
    """How a definition is written, so that it can be written so again: the order of its fields, whether names stand in brackets, the syntax in quotes, and what surrounds it."""
    words = F.lit(r"\b(NAME|DESC|OBSOLETE|SUP|EQUALITY|ORDERING|SUBSTR|SYNTAX|SINGLE-VALUE|COLLECTIVE|NO-USER-MODIFICATION|USAGE|ABSTRACT|STRUCTURAL|AUXILIARY|MUST|MAY|X-[A-Z0-9_-]+)(?=\s|\))")
    bare = F.regexp_replace(definition, r"'[^']*'", "''")
    return F.struct(
        F.regexp_extract_all(bare, words, F.lit(1)).alias("fields"), definition.rlike(r"\bNAME\s+\(").alias("names_bracketed"), definition.rlike(r"\bSYNTAX\s+'").alias("syntax_quoted"),
        definition.rlike(r"\bOBSOLETE\b").alias("obsolete"), definition.rlike(r"\bX-ORIGIN\b").alias("has_origin"),
        F.length(F.regexp_extract(definition, r"^(\s*)", 1)).alias("leading"), F.length(F.regexp_extract(definition, r"(\s*)$", 1)).alias("trailing"), definition.alias("original"),
    )


def restored(definition: Column, fmt: Column) -> Column:
    """The definition written as its original was: fields that say the same keep their text, quotes, brackets and blanks and all; only what was changed, added or removed differs.

    Values count as they are, in their case and with their blanks. Another OID is put in the place of the original one. Without an original, or for a null, the definition stays as it is.
    """
    own = F.struct(definition.alias("definition"), X.lex(definition).alias("lexed"), fmt["original"].alias("original"), X.lex(fmt["original"]).alias("old"))

    def back(x: Column) -> Column:
        changed = X.splice(x["original"], x["old"], X.differences(x, x["old"]))
        old, new = x["old"]["oid"], x["lexed"]["oid"]
        at = F.length(x["old"]["head"]) + F.length(F.regexp_extract(F.substr(changed, F.length(x["old"]["head"]) + 1), r"^\(?\s*", 0))
        renumbered = F.concat(F.substr(changed, F.lit(1), at), new, F.substr(changed, at + F.length(old) + 1))
        return F.when(x["old"].isNull() | x["lexed"].isNull(), x["definition"]).otherwise(F.when(F.coalesce(old != new, F.lit(False)), renumbered).otherwise(changed))

    # once for each row, whatever refers to it
    return F.get(F.transform(F.array(own), back), F.lit(0))


def rewrite_definition(definition: Column, rules: Mapping[str, str] = D.RULES_IN, syntaxes: Mapping[str, str] = D.SYNTAXES_IN) -> Column:
    """A definition with the matching rules and syntaxes of another dialect: a substring rule as EQUALITY becomes the plain one; quotes around SUP go."""
    out = F.regexp_replace(definition, r"EQUALITY caseIgnoreSub[Ss]tringsMatch\b", "EQUALITY caseIgnoreMatch")
    for old, new in rules.items():
        out = F.regexp_replace(out, rf"\bSUBSTR {old}\b", f"SUBSTR {new}")
    for old, new in syntaxes.items():
        out = F.regexp_replace(out, rf"(?<=[ ']){old.replace('.', '[.]')}(?=[ '])", new)
    return F.regexp_replace(out, r"SUP\s+'([^']+)'", "SUP $1")


def convert_schema(attrs: Column, source: str, target: str) -> Column:
    """Schema attributes with their definitions in the target's words; all others as they are."""
    source, target = D.resolve(source), D.resolve(target)

    def change(name: Column, value: Column) -> Column:
        out = without_keyword(value) if source == "openldap1" else value
        if source == "oid" and target != "oid":
            out = rewrite_definition(out)
        elif target == "oid" and source != "oid":
            out = F.regexp_replace(out, r"\bSUBSTR caseIgnoreSubstringsMatch\b", "SUBSTR caseIgnoreSubStringsMatch")
        out = with_keyword(out) if target == "openldap1" else out
        return F.when(name.isin("attributetypes", "objectclasses"), out).otherwise(value)

    return A._map_values(attrs, change)


# --- access rules --------------------------------------------------------------------------------------------------------


def sanitize_name(name: Column, most: int = 128) -> Column:
    """A rule's name without quotes, control and other characters beyond printable ASCII, runs of blanks as one, cut with dots at `most`."""
    plain = N.strip(F.regexp_replace(F.regexp_replace(name, r'[^\x20-\x7E]|"', " "), r" +", " "))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 3), F.lit("..."))).otherwise(plain)


def with_name(aci: Column, name: Column) -> Column:
    """An ACI under another name."""
    return F.concat(F.regexp_extract(aci, r'(?is)^(.*?\bacl\s+")[^"]*"', 1), sanitize_name(name), F.regexp_replace(aci, r'(?is)^.*?\bacl\s+"[^"]*(?=")', ""))


def rule_type(dialect: Column) -> Column:
    """The type of a dialect's access rules, whatever the spelling of the dialect."""
    table = F.create_map(*(F.lit(x) for pair in D.ALIASES.items() for x in pair))
    low = F.lower(N.strip(dialect))
    return F.concat(F.coalesce(F.element_at(table, low), low), F.lit("_acl"))


def rule_violations(dialect: Column, defined: Column, raw: Column) -> Column:
    """What is wrong with an access rule: an unknown dialect, or a rule without its text."""
    known = sorted(("rfc", "openldap", "openldap2", "openldap1", "oid", "oud", "389ds", "ad", "relaxed"))
    table = F.create_map(*(F.lit(x) for pair in D.ALIASES.items() for x in pair))
    low = F.lower(N.strip(dialect))
    name = F.coalesce(F.element_at(table, low), low)
    one = F.when(~name.isin(*known, "ds389"), F.array(F.concat(F.lit("Invalid server_type '"), dialect, F.lit(f"' - expected one of: {', '.join(known)}")))).otherwise(F.array().cast("array<string>"))
    two = F.when(defined & (F.coalesce(N.strip(raw), F.lit("")) == ""), F.array(F.lit("ACL is defined (has target/subject/permissions) but raw_acl is empty"))).otherwise(F.array().cast("array<string>"))
    return F.concat(one, two)


def permission_keys(tokens: Column) -> Column:
    """The permissions that access rules know, in lower case, once each."""
    return F.array_distinct(F.filter(F.transform(tokens, F.lower), lambda t: t.isin(*acl.PERMISSIONS)))


# --- memory of a conversion ------------------------------------------------------------------------------------------------


def remember(df: DataFrame) -> DataFrame:
    """`df` with its name and attributes as they are now in `original`."""
    return df.withColumn("original", F.struct("dn", "attrs"))


def restore(df: DataFrame) -> DataFrame:
    """Remembered entries in their original spelling: names of attributes, and values that only differ as truth values do, as they were; all that was changed since stays."""
    old = F.col("original.attrs")
    names = F.transform(old, lambda a: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in {k: v.lower() for k, v in A.OID_TO_RFC.items()}.items() for x in p)), F.lower(a["name"])), F.lower(a["name"])))
    truth = lambda v: F.when(F.lower(v).isin("1", "true"), F.lit("1")).when(F.lower(v).isin("0", "false"), F.lit("0")).otherwise(v)

    def one(a: Column) -> Column:
        before = F.get(F.filter(F.arrays_zip(names.alias("low"), old.alias("old")), lambda z: z["low"] == F.lower(a["name"])), F.lit(0))["old"]
        values = F.transform(a["values"], lambda v, i: F.when(_same(truth(v["value"]), truth(F.get(before["values"], i)["value"])), F.get(before["values"], i)).otherwise(v))
        return F.when(before.isNull(), a).otherwise(F.struct(before["name"].alias("name"), values.alias("values")))

    return df.withColumn("attrs", F.transform(F.col("attrs"), one).cast(ATTRS)).withColumn("dn", F.when(F.lower(N.norm_dn(F.col("dn"))) == F.lower(N.norm_dn(F.col("original.dn"))), F.col("original.dn")).otherwise(F.col("dn")))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def transformations(before: Column, after: Column) -> Column:
    """(attribute, kind, original, converted) of what a conversion changed, by lower-case name: removed, added and changed attributes, in this order."""
    text = lambda attrs, n: F.array_join(F.flatten(F.transform(F.filter(attrs, lambda a: F.lower(a["name"]) == n), lambda a: F.transform(a["values"], lambda v: v["value"]))), "|")
    x, y = F.array_distinct(A.lower_names(before)), F.array_distinct(A.lower_names(after))
    row = lambda n, kind, old, new: F.struct(n.alias("attribute"), F.lit(kind).alias("kind"), old.alias("original"), new.alias("converted"))
    none = F.lit(None).cast("string")
    changed = F.filter(F.array_intersect(x, y), lambda n: text(before, n) != text(after, n))
    return F.concat(F.transform(F.array_except(x, y), lambda n: row(n, "removed", text(before, n), none)), F.transform(F.array_except(y, x), lambda n: row(n, "added", none, text(after, n))), F.transform(changed, lambda n: row(n, "changed", text(before, n), text(after, n))))


def metadata_json(df: DataFrame, changes: str = "changes") -> Column:
    """A conversion's memory as JSON: the dialects and what changed."""
    have = set(df.columns)
    pick = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return F.to_json(F.struct(pick("original_server_type").alias("original_server_type"), pick("server_type").alias("server_type"), F.col(changes).alias("changes")))


def conversion_metrics(df: DataFrame, changes: str = "changes") -> DataFrame:
    """(original_server_type, server_type, entries, changed, failed, rate): counts of conversions and the percentage without an error to two places."""
    bad = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    out = df.groupBy("original_server_type", "server_type").agg(F.count("*").alias("entries"), F.count_if(F.size(changes) > 0).alias("changed"), F.count_if(bad).alias("failed"))
    return out.withColumn("rate", F.round(100.0 * (F.col("entries") - F.col("failed")) / F.col("entries"), 2))


def category_rules(text: Column) -> Column:
    """Category rules from JSON, a map of lists of object classes; null where it is none."""
    return F.from_json(text, "map<string, array<string>>")


# --- comments --------------------------------------------------------------------------------------------------------------

_BAR = "# " + "=" * 70


def original_comment(original: Column) -> Column:
    """The block that keeps an entry's original text as comments before its converted form. Its lines are fixed values."""
    quoted = F.array_join(F.transform(F.split(original, "\n"), lambda x: F.when(x == "", F.lit("#")).otherwise(F.concat(F.lit("# "), x))), "\n")
    return F.concat_ws("\n", F.lit(_BAR), F.lit("# ORIGINAL Entry (alternative format) (commented)"), F.lit(_BAR), quoted, F.lit(""), F.lit(_BAR), F.lit("# CONVERTED OUD Entry (active)"), F.lit(_BAR))


def change_comments(changes: Column, reason: Column) -> Column:
    """Comment lines for what a conversion changed and why an entry was rejected. The tags are fixed values."""
    line = lambda c: F.when(c["kind"] == "removed", F.concat(F.lit("# [REMOVED] "), c["attribute"], F.lit(": "), c["original"])).when(c["kind"] == "changed", F.concat(F.lit("# [TRANSFORMED] "), c["attribute"], F.lit(": "), c["original"], F.lit(" -> "), c["converted"]))
    told = F.filter(F.transform(changes, line), lambda x: x.isNotNull())
    return F.concat(F.when(reason.isNotNull(), F.array(F.concat(F.lit("# [REJECTION] "), reason))).otherwise(F.array().cast("array<string>")), told)


def as_comments(*blocks: Column) -> Column:
    """Lines of comments, as arrays, as an entry's `comments`, which are written with one number sign each and read back as they are; nulls and blank lines are left out."""
    lines = lambda b: F.filter(b, lambda x: F.btrim(x) != "")
    plain = lambda b: F.transform(lines(b), lambda x: F.regexp_replace(x, r"^#\s?", ""))
    return F.concat(*(F.coalesce(plain(b), F.array().cast("array<string>")) for b in blocks))


# --- the whole way ---------------------------------------------------------------------------------------------------------


def migrate(df: DataFrame, source: str, target: str, *, source_base: str | None = None, target_base: str | None = None, rules: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Entries of one dialect as those of another, with their category: access rules and schema first, then names and attributes, then the base. Rejected entries stay, with a reason."""
    out = df.withColumn("attrs", convert_schema(F.col("attrs"), source, target))
    out = E.process(out, source=source, target=target, base=source_base or "")
    if source_base and target_base:
        out = E.move_base(out, source_base, target_base)
    return E.categorize(out, D.resolve(target), base=target_base or source_base, rules=rules)


def file_roll_up(df: DataFrame) -> DataFrame:
    """(source, entries, rejected, success_rate) of each file, and a row of all files with a null source."""
    out = df.rollup("source").agg(F.count("*").alias("entries"), F.count_if(F.col("category") == "rejected").alias("rejected"))
    return out.withColumn("success_rate", F.round(100.0 * (F.col("entries") - F.col("rejected")) / F.col("entries"), 2))


#: Source files whose entries are counted on the way; more of them are counted in what was written, by file.
MOST_FILES = 1000


def migrate_files(spark: SparkSession, source_path: str, target_path: str, source: str, target: str, **options: object) -> DataFrame:
    """Read LDIF files, migrate them, write a folder of LDIF files for each category, and return the roll-up by file; see `migrate_observed`."""
    return migrate_observed(spark, source_path, target_path, source, target, **options)[0]


def migrate_observed(spark: SparkSession, source_path: str, target_path: str, source: str, target: str, *, mode: str = "errorifexists", by_file: bool = False, **options: object) -> tuple[DataFrame, DataFrame]:
    """(roll-up by file, counts) of LDIF files that are read, migrated and written as LDIF, a folder for each category.

    Files are read and converted once: all counts (metric, n) and those of each file are observed on the rows that are written. With `by_file` each category
    has a folder for each source file (`file=`, by its name), and the roll-up counts the records in them, for any number of files; without it, more than MOST_FILES are an error. `mode` is that of Spark's writers.
    """
    from dirlake.operators import metrics
    from dirlake.sources import ldif

    entries = ldif.read_ldif(spark, source_path)
    sources = [] if by_file else ldif.sources_of(source_path, MOST_FILES)
    done, seen = metrics.observed(migrate(entries, source, target, **options), "migration", sources=sources)
    text = ldif.written(done).select("category", *([F.element_at(F.split("source", "/"), -1).alias("file")] if by_file else []), "ldif")
    text.write.mode(mode).partitionBy("category", *(["file"] if by_file else [])).option("lineSep", "\n\n").text(target_path)
    counts = metrics.report(spark, seen)
    if by_file:
        rows = spark.read.schema("value string, category string, file string").option("lineSep", "\n\n").text(target_path)
        return file_roll_up(rows.select(F.col("file").alias("source"), "category")), counts
    return metrics.by_source(spark, seen, sources), counts
