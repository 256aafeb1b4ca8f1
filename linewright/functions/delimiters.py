"""Delimiters: constants, and what a caller may pass for one."""

from __future__ import annotations

import re
from collections.abc import Iterable
from enum import IntEnum


class Delimiters(IntEnum):
    # The byte of each named delimiter.
    Null = 0
    LineFeed = 10
    CarriageReturn = 13
    Comma = 44
    Tab = 9
    Space = 32
    One = 49
    Zero = 48
    DoubleQuote = 34
    RecordSeparator = 30
    Pipe = 124


#: How control characters are shown.
VISIBLE = {"\n": "␤", "\r": "␍", ",": "-", "\t": "␉", " ": "␠", '"': '"', "\x1e": "␞", "\x00": "␀"}

Delimiter = str | int | bytes | Iterable[int]


def delimiter_bytes(delimiter: Delimiter = "\n", encoding: str = "utf-8") -> bytes:
    """The delimiter as bytes: any sequence of them. Numbers are single bytes; text is encoded.

    An empty delimiter would never advance and is refused, as are numbers that are no byte.
    """
    if isinstance(delimiter, str):
        raw = delimiter.encode(encoding)
    elif isinstance(delimiter, int):
        if not 0 <= delimiter <= 255:
            raise ValueError(f"a numeric delimiter is one byte, not {delimiter}")
        raw = bytes([delimiter])
    elif isinstance(delimiter, (bytes, bytearray)) or (isinstance(delimiter, Iterable) and not isinstance(delimiter, memoryview)):
        raw = bytes(delimiter)
    else:
        raise TypeError(f"no delimiter: {type(delimiter).__name__}")
    if not raw:
        raise ValueError("the delimiter is empty")
    return raw


def parse_delimiter(delimiter: Delimiter = "\n") -> str:
    """The delimiter as text, for columns of text. Bytes that are no UTF-8 are in no text: they part files and BINARY columns."""
    if isinstance(delimiter, str) and delimiter:
        return delimiter
    raw = delimiter_bytes(delimiter)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        raise ValueError(f"{raw!r} is no UTF-8: it can part files and BINARY columns, not text") from None


def pattern(delimiter: str) -> str:
    """A Java regular expression that matches the delimiter literally."""
    return re.sub(r"([^A-Za-z0-9_\s\u0080-\U0010ffff\x00-\x1f])", r"\\\1", delimiter)


def byte_length(delimiter: str) -> int:
    return len(delimiter.encode())
