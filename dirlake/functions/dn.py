r"""Distinguished-name algebra as column expressions.

Every function takes and returns columns, so that Catalyst can push and fold them. A null name gives a null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\x0b\x0c"
#: Characters that a value escapes, and the shape of one name component.
SPECIALS = '"+,;<>\\'
COMPONENT = r"^[a-zA-Z][a-zA-Z0-9-]*=(?:[^\\,]|\\.)*$"
#: Attributes whose values are names.
DN_VALUED = ("member", "uniqueMember", "owner", "managedBy", "manager", "secretary", "seeAlso", "parent", "refersTo", "memberOf", "groups", "authorizedTo", "hasSubordinates", "subordinateDn")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def attr_of(component: Column) -> Column:
    return F.lower(strip(F.substring_index(component, "=", 1)))


def value_of(component: Column) -> Column:
    """What follows the first equals sign."""
    return strip(F.substring(component, F.instr(component, "=") + 1, F.length(component)))


def split_dn(dn: Column) -> Column:
    """Components between unescaped commas, trimmed, empty ones left out."""
    parts = F.regexp_extract_all(dn, F.lit(r"(?:[^,\\]++|\\.|\\$)++"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def norm_dn(dn: Column) -> Column:
    """Attribute types in lower case, blanks around the parts dropped, values as they are; null without any `=`."""
    parts = F.filter(split_dn(dn), lambda p: p.contains("="))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(attr_of(p), F.lit("="), value_of(p))), ",")
    # named once, so that the parts are not split again for a condition
    return F.get(F.filter(F.array(joined), lambda name: name != ""), F.lit(0))


def norm_or_lower(dn: Column) -> Column:
    """The normal form, or where there is none the name in lower case; empty for a null."""
    return F.coalesce(norm_dn(dn), F.lower(dn), F.lit(""))


def depth(dn: Column) -> Column:
    return F.size(split_dn(dn))


def parent(dn: Column) -> Column:
    """All components but the first, in normal form; null at the top."""
    parts = F.filter(split_dn(norm_dn(dn)), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ","))


def ancestors(dn: Column) -> Column:
    """All names above, nearest first: what turns an under-base search into an equi-join."""
    parts = split_dn(norm_dn(dn))
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ",")))


def rdn_pairs(dn: Column) -> Column:
    """(attr, value) pairs of all components; a multi-valued one gives several."""
    pairs = F.flatten(F.transform(split_dn(dn), lambda p: F.regexp_extract_all(p, F.lit(r"(?:\\.|[^+\\])+"), F.lit(0))))
    return F.transform(F.filter(pairs, lambda p: p.contains("=")), lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("attr"), value_of(p).alias("value")))


def is_under_base(dn: Column, base: Column) -> Column:
    """Whether a name is the base or ends with it, whatever the case; blanks inside count. False for nulls and empty names."""
    name, end = F.lower(strip(dn)), F.lower(strip(base))
    return F.coalesce((name != "") & (end != "") & ((name == end) | F.endswith(name, F.concat(F.lit(","), end))), F.lit(False))


def compare_dn(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the normal forms, whatever the case; null if either has none."""
    x, y = F.lower(norm_dn(a)), F.lower(norm_dn(b))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def esc(value: Column) -> Column:
    """Specials, edge blanks and a leading `#` as a backslash and two hex digits."""
    inner = reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit(f"\\{ord(ch):02x}")), "\\" + SPECIALS.replace("\\", ""), value)
    led = F.when(F.startswith(inner, F.lit(" ")), F.concat(F.lit("\\20"), F.substring(inner, F.lit(2), F.length(inner)))).when(F.startswith(inner, F.lit("#")), F.concat(F.lit("\\23"), F.substring(inner, F.lit(2), F.length(inner)))).otherwise(inner)
    return F.when(F.endswith(led, F.lit(" ")), F.concat(F.substring(led, F.lit(1), F.length(led) - 1), F.lit("\\20"))).otherwise(led)


def unesc(value: Column) -> Column:
    """`\\XX` as the character of that code, any other escaped character as itself."""
    parts = F.regexp_extract_all(value, F.lit(r"(?s)\\[0-9a-fA-F]{2}|\\.|[^\\]|\\$"), F.lit(0))
    plain = lambda p: F.when(p.rlike(r"^\\[0-9a-fA-F]{2}$"), F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))).when((F.length(p) == 2) & F.startswith(p, F.lit("\\")), F.substring(p, 2, 1)).otherwise(p)
    return F.when(value.contains("\\"), F.array_join(F.transform(parts, plain), "")).otherwise(value)


#: The cleaning steps in their order, with the flag that each one sets.
CLEANING = (
    ("had_tabs", r"[\t\r\n\x0b\x0c]", " "),
    ("had_spaces_before_equals", r"\s+=", "="),
    ("had_trailing_backslash", r"\\\\s+,", ","),
    ("had_spaces_before_comma", r"\s+,", ","),
    ("had_spaces_after_comma", r",\s+", ","),
    ("had_needless_escapes", r'\\([^,+"\<>;\\# ])', "$1"),
    ("had_double_spaces", r"\s+", " "),
)


def clean_dn(dn: Column) -> Column:
    """Blanks around separators, runs of blanks and needless escapes removed."""
    return reduce(lambda c, step: F.regexp_replace(c, step[1], step[2]), CLEANING, dn)


def clean_dn_stats(dn: Column) -> Column:
    """A struct of the cleaned name and, for each step, whether it changed what the steps before it left."""
    flags, now = [], dn
    for name, pattern, new in CLEANING:
        after = F.regexp_replace(now, pattern, new)
        flags.append((after != now).alias(name))
        now = after
    return F.struct(now.alias("cleaned"), *flags)


#: Characters that may not stand first, inside or last in a value's string form.
LEAD, INNER, TRAIL = ' "#+,;<>\\', '"+,;<>\\', ' "+,;<>\\'


def string_char_ok(char: Column, where: str = "inner") -> Column:
    """Whether one character may stand at the `lead`, `inner` or `trail` place of a value's string form: ASCII, not null, and not one of that place's specials."""
    bad = {"lead": LEAD, "inner": INNER, "trail": TRAIL}[where]
    return F.coalesce((F.length(char) == 1) & char.rlike(r"^[\x01-\x7F]$") & ~F.lit(bad).contains(char), F.lit(False))


def string_errors(value: Column, strict: bool = True) -> Column:
    """What is wrong with a value's string form: its first, last and inner characters, unless a backslash stands before them. Without `strict` nothing is."""
    none = F.array().cast("array<string>")
    if not strict:
        return F.when(value.isNotNull(), none)
    quote = lambda c: F.concat(F.when(c == "'", F.lit('"')).otherwise(F.lit("'")), F.replace(c, F.lit("\\"), F.lit("\\\\")), F.when(c == "'", F.lit('"')).otherwise(F.lit("'")))
    n, at = F.length(value), lambda i: F.substring(value, i, F.lit(1))
    first, last = at(F.lit(1)), at(n)
    lead = F.when(~string_char_ok(first, "lead") & ~((first == "\\") & (n > 1)), F.array(F.concat(F.lit("Invalid lead character: "), quote(first)))).otherwise(none)
    trail = F.when((n > 1) & ~string_char_ok(last, "trail") & (at(n - 1) != "\\"), F.array(F.concat(F.lit("Invalid trail character: "), quote(last)))).otherwise(none)
    places = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    bad = F.filter(places, lambda i: ~string_char_ok(at(i), "inner") & (at(i) != "\\") & (at(i - 1) != "\\"))
    inner = F.transform(bad, lambda i: F.concat(F.lit("Invalid character at position "), (i - 1).cast("string"), F.lit(": "), quote(at(i))))
    return F.when(value == "", none).when(value.isNotNull(), F.concat(lead, trail, inner))


def squeezed(dn: Column) -> Column:
    """A name without blanks around its commas and equals signs: the form that access rules compare."""
    return strip(F.regexp_replace(F.regexp_replace(dn, r"\s*,\s*", ","), r"\s*=\s*", "="))


def is_valid_dn(dn: Column) -> Column:
    """Whether all components have the shape `type=value` and escapes are two hex digits or a special; a backslash among the last two characters is not valid."""
    shaped = F.forall(split_dn(dn), lambda p: p.rlike(COMPONENT))
    broken = dn.rlike(r'(?<!\\),\s*,|\\(?![0-9a-fA-F]{2}|[,+"\\<>;])|\\.?$')
    return F.coalesce((strip(dn) != "") & (depth(dn) > 0) & shaped & ~broken, F.lit(False))


def rebase(dn: Column, source: str, target: str) -> Column:
    """The normal form with the base `source`, whatever its case, replaced by `target`."""
    name = F.coalesce(norm_dn(dn), dn)
    low, base = F.lower(name), source.lower()
    cut = F.substring(name, F.lit(1), F.length(name) - len(source))
    return F.when(low == base, F.lit(target)).when(F.endswith(low, F.lit("," + base)), F.concat(cut, F.lit(target))).otherwise(name)


def registry(df: DataFrame, dn: str = "dn", order: str = "record_no") -> DataFrame:
    """(key, canonical, variants, consistent): each name whatever its case and blanks, its first spelling, and how many there are. A pre-aggregated group, so hot names do no harm."""
    key = F.lower(F.replace(F.col(dn), F.lit(" "), F.lit("")))
    each = df.where(F.col(dn).isNotNull()).groupBy(key.alias("key"), F.col(dn).alias("dn")).agg(F.min(order).alias("at"))
    return each.groupBy("key").agg(F.min_by("dn", "at").alias("canonical"), F.count("*").alias("variants")).withColumn("consistent", F.col("variants") == 1)


def canonical(df: DataFrame, dn: str = "dn", order: str = "record_no") -> DataFrame:
    """`df` with `canonical_dn`, the first spelling of each name."""
    first = Window.partitionBy(F.lower(F.replace(F.col(dn), F.lit(" "), F.lit("")))).orderBy(order)
    return df.withColumn("canonical_dn", F.first(dn).over(first))
