"""Decoding bytes the way a web text decoder does."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.exprs import strip_bom

#: Encodings that Spark decodes itself, by Python's names for them.
_WIDE = {"utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32": "UTF-32"}
#: On the web these mean Windows-1252, whose unused bytes are control characters.
_WESTERN = ("iso8859-1", "ascii", "cp1252")


def byte_table(encoding: str) -> str:
    """The character of each of the 256 bytes of a single-byte encoding; unused ones are U+FFFD."""
    name = codecs.lookup(encoding).name
    if name in _WESTERN:
        return "".join(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(256))
    each = "".join(bytes([b]).decode(name, "replace") for b in range(256))
    if len(each) != 256 or bytes(range(256)).decode(name, "replace") != each:
        raise LookupError(f"{encoding} is no encoding of single bytes, nor of Unicode")
    return each


def decode(value: Column, encoding: str = "utf-8", fatal: bool = False, ignore_bom: bool = False) -> Column:
    """BINARY (or STRING with raw bytes) to text: malformed UTF-8 and unused bytes become U+FFFD, or an error with ``fatal``.

    A byte order mark at the start of the slice goes unless ``ignore_bom``. Encodings are UTF-8, UTF-16, UTF-32 (in
    which malformed bytes are an error in any case: Spark's decoder has no replacement for them) and all of single bytes.
    """
    name = codecs.lookup(encoding).name
    if name == "utf-8":
        raw = value.cast("string")
        text = F.validate_utf8(raw) if fatal else F.make_valid_utf8(raw)
    elif name in _WIDE:
        text = F.decode(value.cast("binary"), _WIDE[name])
    else:
        table = byte_table(encoding)
        text = F.decode(value.cast("binary"), "ISO-8859-1")
        unlike = [b for b in range(256) if table[b] != chr(b)]
        if unlike:
            text = F.translate(text, "".join(map(chr, unlike)), "".join(table[b] for b in unlike))
        if fatal and "�" in table:
            text = F.when(F.contains(text, F.lit("�")), F.raise_error(F.lit(f"a byte that {encoding} does not use")).cast("string")).otherwise(text)
    return text if ignore_bom else strip_bom(text)
