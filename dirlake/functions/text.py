"""LDIF text pieces: unfolding, folding, base64 and safe characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a folded line, and attributes that are always written as base64.
WIDTH = 76
BINARY = ("usercertificate", "cacertificate", "certificaterevocationlist", "authorityrevocationlist", "crosscertificatepair", "photo", "jpegphoto", "audio", "userpkcs12", "usersmimecertificate", "thumbnailphoto", "thumbnaillogo", "objectguid", "objectsid")
#: Fixed value: attributes whose lines are never folded.
UNFOLDED = ("acl", "aci", "olcaccess")
#: Text that starts with a blank, colon or less-than sign, ends with a blank, or has a character beyond printable text.
UNSAFE = r"^[ :<]| $|[^\x01-\x7F]|[\n\r]"
_UNSAFE = re.compile(UNSAFE)


def unfold(text: Column) -> Column:
    """Continuation lines joined to the line that is open before them."""
    return F.regexp_replace(text, r"(?<=[^\n])\n[ \t]", "")


def unfold_text(text: str) -> str:
    return re.sub(r"(?<=[^\n])\n[ \t]", "", text)


def needs_base64(value: Column) -> Column:
    """Whether a value is unsafe text, which is written as base64."""
    return F.coalesce(value.rlike(UNSAFE), F.lit(False))


def is_unsafe(value: str) -> bool:
    return bool(_UNSAFE.search(value))


def is_binary(name: Column) -> Column:
    return F.lower(F.substring_index(name, ";", 1)).isin(*BINARY)


def from_base64(payload: Column) -> Column:
    """The text of a base64 payload; one that is not base64 stays as it is, bytes that are not UTF-8 are replaced."""
    return F.coalesce(F.make_valid_utf8(F.try_to_binary(payload, F.lit("base64")).cast("string")), payload)


def to_base64(value: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(F.encode(value, "utf-8")), r"\s", "")


def fold_text(line: str, width: int = WIDTH) -> str:
    """A line over `width` bytes as lines of that many at most, each after the first opened by a blank: every line takes all whole characters that fit."""
    raw = line.encode()
    out, lo, room = [], 0, width
    while len(raw) - lo > room:
        hi = lo + room
        # a continuation byte may not open a line
        while hi > lo + 1 and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(raw[lo:hi])
        lo, room = hi, width - 1
    return b"\n ".join([*out, raw[lo:]]).decode()


def fold_line(line: Column, width: int = WIDTH) -> Column:
    """Fold at UTF-8 bounds; lines of `width` bytes at most stay as they are."""

    @F.arrow_udf("string")
    def folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in batches:
            yield pa.array([None if x is None else fold_text(x, width) for x in lines.to_pylist()], pa.string())

    return folded(line)
