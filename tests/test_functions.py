import pytest
from pyspark.sql import functions as F

from dirlake import dialects
from dirlake.functions import acl
from dirlake.functions import dn as N
from dirlake.functions import schema4512 as S
from dirlake.functions import validate as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("text", "norm"), [("CN=a+SN=b", "cn=a+SN=b"), ("none", None), ("", None), ("OU = x , DC=Y,", "ou=x,dc=Y"), ("cn=a\\,b,x", "cn=a\\,b")])
def test_norm(spark, text, norm):
    assert one(spark, N.norm_dn(F.lit(text))) == (norm,)


@pytest.mark.parametrize(("text", "ok"), [("cn=a\\,b,dc=x", True), ("cn=a\\\\b", False), ("cn=a\\#b", False), ("cn=a\\", False), ("", False), ("cn=a,,dc=b", False), ("cn=\\C3\\A9t,dc=b", True)])
def test_valid(spark, text, ok):
    assert one(spark, N.is_valid_dn(F.lit(text))) == (ok,)


def test_base_keeps_inner_blanks(spark):
    assert one(spark, N.is_under_base(F.lit("ou=a, dc=x"), F.lit("dc=x")), N.is_under_base(F.lit("OU=a,DC=X "), F.lit("dc=x")), N.is_under_base(F.lit(None).cast("string"), F.lit("dc=x"))) == (False, True, False)


@pytest.mark.parametrize("text", [" a", "a ", "#a", "a,b+c<d>e;f\\g", ' "', " ", "plain"])
def test_escape_round_trip(spark, text):
    escaped, back = one(spark, N.esc(F.lit(text)), N.unesc(N.esc(F.lit(text))))
    assert back == text and not any(c in escaped for c in '"+,;<>')


def test_nulls(spark):
    none = F.lit(None).cast("string")
    assert one(spark, N.norm_dn(none), N.parent(none), N.clean_dn(none), N.esc(none), N.is_valid_dn(none), V.attribute_name_ok(none), N.norm_or_lower(none)) == (None, None, None, None, False, False, "")


def test_schema_round_trip(spark):
    text = "( 2.5.4.3 NAME 'cn' DESC 'common name' SUP name EQUALITY caseIgnoreMatch SYNTAX 1.3.6.1{64} SINGLE-VALUE )"
    assert one(spark, S.write_attribute_type(S.attribute_type(F.lit(text)))) == (text,)
    text = "( 2.5.6.6 NAME 'person' SUP top STRUCTURAL MUST ( sn $ cn ) MAY seeAlso )"
    assert one(spark, S.write_object_class(S.object_class(F.lit(text)))) == (text,)
    assert one(spark, S.object_class(F.lit("( 1.2 NAME 'x' SUP ( a $ b ) )"))["sup"], S.object_class(F.lit("( 1.2 )"))["kind"], S.kind_of(F.lit("( 1 MUST cn )"))) == ("a", "STRUCTURAL", "objectclass")


RULES = [
    ("ou=staff,o=lab", 'access to entry by group="cn=ops,o=lab" (browse, delete) by * (none)', False, '(targetattr="*")(version 3.0; acl "staff Entry by ops"; allow (read, search, delete) groupdn="ldap:///cn=ops,o=lab";)'),
    ("ou=staff,o=lab", "access to attr=(title,l) by * (compare,read)", False, '(targetattr="title||l")(targetscope="base")(version 3.0; acl "staff Attrs by anyone"; allow (read, compare) userdn="ldap:///anyone";)'),
    ("ou=staff,o=lab", "access to entry by dnattr=(owner) (add)", False, '(targetattr="*")(version 3.0; acl "staff Entry by owner"; allow (add) userattr="owner#USERDN";)'),
    ("ou=staff,o=lab", 'access to entry by dn="cn=bot,o=lab" (proxy)', True, '(targetattr="*")(targetscope="base")(version 3.0; acl "staff Entry by bot"; allow (proxy) userdn="ldap:///cn=bot,o=lab";)'),
    ("ou=x,o=lab", "access to attr!=(pin) filter=(|(l=a)(l=b)) by self (all,nowrite)", False, '(targetattr!="pin")(targetfilter="(|(l=a)(l=b))")(version 3.0; acl "x Attrs by self"; allow (read, search, selfwrite, compare) userdn="ldap:///self";)'),
    ("ou=x,o=lab", "access to entry by * (none) by superuser (all)", False, None),
]


@pytest.mark.parametrize(("dn", "rule", "level", "aci"), RULES)
def test_oid_rules(dn, rule, level, aci):
    assert acl.translate_oid_rule(dn, rule, level)[0] == aci


def test_oid_rule_scope_and_unknown_tokens(spark):
    assert acl.translate_oid_rule("dc=c", "access to entry by * (browse)", base="dc=c") == (None, ["anyone at a high-level container"])
    assert acl.translate_oid_rule("ou=top,dc=c", "access to entry by * (browse)", base="dc=c", high_level=("", "ou=top,")) == (None, ["anyone at a high-level container"])
    assert acl.translate_oid_rule("cn=a,dc=c", 'access to entry by group="cn=g,dc=z" (browse)', base="dc=c")[1] == ["out of scope: cn=g,dc=z"]
    assert one(spark, acl.oid_to_oud(F.lit("dc=c"), F.lit("access to entry by self (fly)"))["error"]) == ("unknown permission: fly",)
    assert one(spark, acl.oid_to_oud(F.lit(None).cast("string"), F.lit(None).cast("string"))["aci"]) == (None,)


def test_dialect_names():
    assert dialects.resolve(" OpenLDAP ") == "openldap2" and dialects.resolve("Oracle_OID") == "oid"
    with pytest.raises(ValueError, match="unknown dialect"):
        dialects.resolve("x500")
