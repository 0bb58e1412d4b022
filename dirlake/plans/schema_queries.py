"""Queries over schema definitions that are read, written and changed field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirlake.functions import lexer4512 as X
from dirlake.operators import compat as C
from dirlake.plans.compat_queries import cases

#: Between the original definition and the one that takes its place.
_MARK = " => "


def _halves(x: Column) -> tuple[Column, Column]:
    return F.substring_index(x, _MARK, 1), F.substring_index(x, _MARK, -1)


def _restored(x: Column) -> Column:
    old, new = _halves(x)
    return C.restored(new, C.formatting(old))


def _fields(x: Column) -> Column:
    shown = F.transform(X.lex(x)["fields"], lambda f: F.concat(f["name"], F.lit("="), F.array_join(f["values"], "+"), F.lit(":"), f["first"].cast("string"), F.lit("-"), f["last"].cast("string")))
    return F.concat_ws(";", X.lex(x)["oid"], F.array_join(shown, ";"), X.lex(x)["error"])


_PAIRS = [
    # blanks, brackets, the quotes of a syntax and the order of fields are the original's
    ("(  1.2   NAME '@'  SYNTAX '1.3' )", "( 1.2 NAME '@' SYNTAX 1.3 )", "(  1.2   NAME '@'  SYNTAX '1.3' )"),
    ("( 1.2 NAME ( '@' ) SUP  top )", "( 1.2 NAME '@' SUP top )", "( 1.2 NAME ( '@' ) SUP  top )"),
    ("( 1.2 DESC 'a \\27@\\27 (b) NAME c'  NAME '@' )", "( 1.2 NAME '@' DESC 'a \\27@\\27 (b) NAME c' )", "( 1.2 DESC 'a \\27@\\27 (b) NAME c'  NAME '@' )"),
    # a changed case, blank, list, extension or number is not lost, and nothing else changes
    ("( 1.2  NAME 'Abc@' DESC 'x' )", "( 1.2 NAME 'abc@' DESC 'x' )", "( 1.2  NAME 'abc@' DESC 'x' )"),
    ("( 1.2 NAME '@'  DESC 'My  Text'  SUP name )", "( 1.2 NAME '@' DESC 'My Text' SUP name )", "( 1.2 NAME '@'  DESC 'My Text'  SUP name )"),
    ("( 1.2 NAME '@' MUST ( cn$sn )  MAY l )", "( 1.2 NAME '@' MUST ( cn $ sn $ c ) MAY l )", "( 1.2 NAME '@' MUST ( cn $ sn $ c )  MAY l )"),
    ("( 1.2 NAME '@'\tX-ORIGIN 'RFC @'  X-ORDERED ( 'a' 'b' ) )", "( 1.2 NAME '@' X-ORIGIN 'other' X-ORDERED ( 'a' 'b' ) )", "( 1.2 NAME '@'\tX-ORIGIN 'other'  X-ORDERED ( 'a' 'b' ) )"),
    ("attributetype (1.2 NAME '@')", "( 1.2.9 NAME '@' )", "attributetype (1.2.9 NAME '@')"),
    # fields that were added or removed
    ("( 1.2 NAME '@'  USAGE dSAOperation  )", "( 1.2 NAME '@' OBSOLETE USAGE dSAOperation )", "( 1.2 NAME '@' OBSOLETE  USAGE dSAOperation  )"),
    ("( 1.2 NAME '@'   SINGLE-VALUE   USAGE directoryOperation )", "( 1.2 NAME '@' USAGE directoryOperation )", "( 1.2 NAME '@'   USAGE directoryOperation )"),
    ("(1.2)", "( 1.2 NAME '@' DESC 'é' )", "(1.2 NAME '@' DESC 'é')"),
]
cases("schema_restored_fields", [(old + _MARK + new, want) for old, new, want in _PAIRS], _restored)
cases(
    "schema_fields",
    [
        ("( 1.2 NAME ( 'é' 'b' ) SUP name )", "1.2;NAME=é+b:6-22;SUP=name:23-31"), ("( a-oid NAME 'x'SUP ( top$person ) OBSOLETE )", "a-oid;NAME=x:8-16;SUP=top+person:16-34;OBSOLETE=:35-43"),
        ("( 1.2 DESC 'no SUP (here' SYNTAX 1.3{64} )", "1.2;DESC=no SUP (here:6-25;SYNTAX=1.3{64}:26-40"), ("( 1.2 DESC 'open", "1.2;DESC=open:6-16;open quote"), ("( 1.2 MAY ( cn", "1.2;MAY=cn:6-14;open bracket"),
        ("( 1.2 DESC 'it\\27s \\5Cx' X-A 'b' X-B ( 'c' 'd' ) )", "1.2;DESC=it's \\x:6-24;X-A=b:25-32;X-B=c+d:33-48"), ("NAME 'y'", "NAME=y:0-8"), ("", ""), (None, ""),
    ],
    _fields,
)
cases(
    "schema_written_whole",
    [(x, x) for x in (
        "( 1.2 NAME ( '@' 'b' 'c' ) DESC 'it\\27s' OBSOLETE SUP name EQUALITY e ORDERING o SUBSTR s SYNTAX 1.3{64} SINGLE-VALUE COLLECTIVE NO-USER-MODIFICATION USAGE dSAOperation X-ORIGIN 'RFC @' X-ORDERED ( 'a' 'b' ) )",
        "( 1.3 NAME '@' OBSOLETE SUP ( top $ person ) AUXILIARY MUST ( cn $ sn ) MAY l X-ORIGIN 'x' )", "( 1.4 )", "( oid-@ DESC '' )",
    )],
    lambda x: X.write(X.parsed(X.lex(x))),
)
cases(
    "schema_field_changed",
    [
        ("(  1.2  NAME '@'  DESC 'old'  OBSOLETE\tSUP ( a$b ) X-ORIGIN 'r' )", "(  1.2  NAME '@'  DESC 'new'\tSUP ( a$b ) MAY cn X-ORIGIN 'r' )"), ("(1.2)", "(1.2 DESC 'new' MAY cn)"), ("()", "( DESC 'new' MAY cn)"), ("x ( 1.2 MAY ( a$b )OBSOLETE)", "x ( 1.2 DESC 'new' MAY cn)"),
    ],
    lambda x: X.with_changes(x, [("DESC", F.lit("DESC 'new'")), ("OBSOLETE", F.lit(None)), ("MAY", F.lit("MAY cn"))]),
)
cases(
    "schema_keyword_whole",
    [
        ("( 1.2 NAME ( '@' 'b' ) DESC 'no OBSOLETE' OBSOLETE SUP name EQUALITY e ORDERING o SUBSTR s SYNTAX 1.3{64} SINGLE-VALUE NO-USER-MODIFICATION USAGE dSAOperation X-ORIGIN 'RFC' )", "attributetype ( 1.2 NAME ( '@' 'b' ) DESC 'no OBSOLETE' OBSOLETE SUP name SYNTAX 1.3{64} EQUALITY e ORDERING o SUBSTR s SINGLE-VALUE NO-USER-MODIFICATION USAGE dSAOperation )|X-ORIGIN"),
        ("( 1.3 NAME '@' SUP ( top $ person ) AUXILIARY MAY l X-A 'b' X-B 'c' )", "objectclass ( 1.3 NAME '@' SUP ( top $ person ) AUXILIARY MAY ( l ) )|X-A,X-B"), ("( 1.4 NAME '@' DESC 'SINGLE-VALUE' SYNTAX 1.5 )", "attributetype ( 1.4 NAME '@' DESC 'SINGLE-VALUE' SYNTAX 1.5 )|"),
    ],
    lambda x: F.concat_ws("|", C.with_keyword(x), F.array_join(C.lost_with_keyword(x), ",")),
)
