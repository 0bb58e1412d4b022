"""Schema definitions (attribute types and object classes) parsed from and written to text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.functions.dn import strip


def _part(definition: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern; null where it does not match."""
    found = F.regexp_extract(definition, pattern, group)
    return F.when(found != "", found)


def _list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\$"), strip), lambda x: x != "")


def oid_of(definition: Column) -> Column:
    return _part(definition, r"\(\s*([0-9.]+)")


def names_of(definition: Column) -> Column:
    """All names of a definition."""
    many = F.regexp_extract(definition, r"(?i)NAME\s+(\([^)]*\)|'[^']*')", 1)
    return F.regexp_extract_all(many, F.lit(r"'([^']+)'"), F.lit(1))


def attribute_type(definition: Column) -> Column:
    """A struct of the fields of an attribute type; fields that are not there are null, flags false."""
    return F.struct(
        oid_of(definition).alias("oid"), _part(definition, r"(?i)NAME\s+\(?\s*'([^']+)'").alias("name"), _part(definition, r"DESC\s+'([^']+)'").alias("desc"),
        _part(definition, r"SUP\s+'?(\w+)'?").alias("sup"), _part(definition, r"EQUALITY\s+([^\s)]+)").alias("equality"), _part(definition, r"ORDERING\s+([^\s)]+)").alias("ordering"), _part(definition, r"SUBSTR\s+([^\s)]+)").alias("substr"),
        _part(definition, r"SYNTAX\s+'?([0-9.]+)").alias("syntax"), _part(definition, r"SYNTAX\s+'?[0-9.]+'?\{(\d+)\}").cast("int").alias("length"),
        definition.rlike(r"\bSINGLE-VALUE\b").alias("single_value"), definition.rlike(r"\bNO-USER-MODIFICATION\b").alias("no_user_modification"), _part(definition, r"USAGE\s+(\w+)").alias("usage"),
    )


def _listed(definition: Column, word: str) -> Column:
    """The names behind a keyword, one or several in brackets."""
    return _list(F.coalesce(_part(definition, rf"{word}\s+\(\s*([^)]+)\)"), _part(definition, rf"{word}\s+'?(\w+)'?")))


def superiors(definition: Column) -> Column:
    """All superiors of an object class."""
    return _listed(definition, "SUP")


def object_class(definition: Column) -> Column:
    """A struct of the fields of an object class. Without a kind it is STRUCTURAL; of several superiors the first counts."""
    listed = lambda word: _listed(definition, word)
    return F.struct(
        oid_of(definition).alias("oid"), _part(definition, r"(?i)NAME\s+\(?\s*'([^']+)'").alias("name"), _part(definition, r"DESC\s+'([^']+)'").alias("desc"), F.get(listed("SUP"), F.lit(0)).alias("sup"),
        F.coalesce(_part(definition, r"\b(ABSTRACT|STRUCTURAL|AUXILIARY)\b"), F.lit("STRUCTURAL")).alias("kind"), listed("MUST").alias("must"), listed("MAY").alias("may"),
    )


def kind_of(definition: Column) -> Column:
    """`objectclass` or `attribute`, by the words that only one of them has."""
    return F.when(definition.rlike(r"\b(STRUCTURAL|AUXILIARY|ABSTRACT|MUST|MAY)\b"), "objectclass").otherwise("attribute")


def _if(c: Column, *parts: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(*parts))


def write_attribute_type(a: Column) -> Column:
    """The text of an attribute type; null fields are left out."""
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    syntax = F.concat(F.lit("SYNTAX "), a["syntax"], F.coalesce(F.concat(F.lit("{"), a["length"].cast("string"), F.lit("}")), F.lit("")))
    words = [a["oid"], _if(a["name"], F.lit("NAME "), q(a["name"])), _if(a["desc"], F.lit("DESC "), q(a["desc"])), _if(a["sup"], F.lit("SUP "), a["sup"]), _if(a["equality"], F.lit("EQUALITY "), a["equality"]), _if(a["ordering"], F.lit("ORDERING "), a["ordering"]), _if(a["substr"], F.lit("SUBSTR "), a["substr"]), syntax, F.when(a["single_value"], F.lit("SINGLE-VALUE")), F.when(a["no_user_modification"], F.lit("NO-USER-MODIFICATION")), _if(a["usage"], F.lit("USAGE "), a["usage"])]
    return F.concat(F.lit("( "), F.concat_ws(" ", *words), F.lit(" )"))


def write_object_class(o: Column) -> Column:
    """The text of an object class; lists of several names stand in brackets."""
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    listed = lambda word, c: F.when(F.size(c) > 1, F.concat(F.lit(word + " ( "), F.array_join(c, " $ "), F.lit(" )"))).when(F.size(c) == 1, F.concat(F.lit(word + " "), c[0]))
    return F.concat(F.lit("( "), F.concat_ws(" ", o["oid"], _if(o["name"], F.lit("NAME "), q(o["name"])), _if(o["desc"], F.lit("DESC "), q(o["desc"])), _if(o["sup"], F.lit("SUP "), o["sup"]), o["kind"], listed("MUST", o["must"]), listed("MAY", o["may"])), F.lit(" )"))


#: Spellings of matching rules that are put right.
RULE_SPELLINGS = {"caseIgnoreSubstringMatch": "caseIgnoreSubstringsMatch", "CaseIgnoreMatch": "caseIgnoreMatch", "CaseExactMatch": "caseExactMatch"}


def normal_rule(rule: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in RULE_SPELLINGS.items() for x in pair))
    return F.coalesce(F.element_at(table, rule), rule)


def oid_allowed(definition: Column, allowed: list[str]) -> Column:
    """Whether a definition's OID is in a whitelist; `*` at the end of a pattern stands for any rest, an empty list allows all."""
    oid = oid_of(definition)
    out = F.lit(not allowed)
    for p in allowed:
        out = out | oid.rlike("^" + p.replace(".", r"\.").replace("*", ".*") + "$")
    return F.coalesce(out, F.lit(False))


def missing_attributes(classes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(object_class, attribute): attributes that classes (name, must, may) name and `attributes` (name) does not define; an anti-join on the lower-case name."""
    wanted = classes.select(F.col("name").alias("object_class"), F.explode(F.array_distinct(F.concat("must", "may"))).alias("attribute"))
    known = attributes.select(F.lower("name").alias("low")).distinct()
    return wanted.join(known, F.lower("attribute") == F.col("low"), "left_anti")
