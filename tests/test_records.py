"""The record contract, case by case."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.functions import exprs
from linewright.functions.delimiters import Delimiters, delimiter_bytes, parse_delimiter
from linewright.operators.records import byte_ranges, logical_rows, records, split_records


def toggled(text, delimiter=","):
    """Quote-aware splitting, one character after the other."""
    parts, inside, at = [""], False, 0
    while at < len(text):
        if not inside and text.startswith(delimiter, at):
            parts.append("")
            at += len(delimiter)
            continue
        inside ^= text[at] == '"'
        parts[-1] += text[at]
        at += 1
    return parts


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("a\nb\n", {}, ["a", "b"]),
        ("a\nb\n", {"skip_empty": False}, ["a", "b", ""]),
        ("", {}, []),
        ("", {"skip_empty": False}, [""]),
        ("\n\n\n", {"skip_empty": False}, ["", "", "", ""]),
        ("\n\n\n", {}, []),
        (" \n\t\n", {}, [" ", "\t"]),
        ("a\rb\nc", {}, ["a\rb", "c"]),
        ("a\r\nb\r\nc", {"crlf": True}, ["a", "b", "c"]),
        ("a\r\nb", {}, ["a\r", "b"]),
        ("a\r\nb\r", {"crlf": True}, ["a", "b\r"]),
        ("a\r\n\r\nb", {"crlf": True}, ["a", "b"]),
        ("a\r\n\r\nb", {"crlf": True, "skip_empty": False}, ["a", "", "b"]),
        ("\na\n\nb\nc", {"drop": 1, "take": 1}, ["b"]),
        ("a\nb", {"drop": -3, "take": 1}, ["a"]),
        ("a\nb", {"take": 0}, []),
        ("a\nb", {"drop": 9}, []),
        ("aa||b|c||", {"delimiter": "||"}, ["aa", "b|c"]),
        ("aaa", {"delimiter": "aa", "skip_empty": False}, ["", "a"]),
        ("xa.b", {"delimiter": ".", "position": 1}, ["a", "b"]),
        ("ab", {"position": 2, "skip_empty": False}, [""]),
        ("a$^b", {"delimiter": "$^"}, ["a", "b"]),
        ('red;"green\n\nblue";\n\n"', {"quotes": True}, ['red;"green\n\nblue";', '"']),
        ('5"6;7"8;9', {"delimiter": ";", "quotes": True}, ['5"6;7"8', "9"]),
    ],
)
def test_records(one, text, options, want):
    assert one(lambda c: records(c, **{"delimiter": "\n"} | options), text) == want


def test_long_run_of_delimiters(one):
    assert one(lambda c: F.size(records(c)), "a" + "\n" * 200_000 + "b") == 2
    assert one(lambda c: F.size(records(c, skip_empty=False)), "\n" * 200_000) == 200_001


def test_emoji_delimiter(one):
    mark = "👩🏼‍❤️‍👩🏻"
    assert one(lambda c: records(c, mark), f"Alpha{mark}Bravo") == ["Alpha", "Bravo"]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text('a",x' + "".join(map(chr, range(32))), max_size=20), min_size=1, max_size=40))
def test_quoted_split_is_the_toggle_scan(spark, texts):
    texts = [*texts, "".join(map(chr, range(32))) * 2 + '",x"', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for d in (",", ",x", "\x01", "\x02\x03", "\x01\x02\x03\x04"):
        got = {r["i"]: r["p"] for r in df.select("i", exprs.split_quoted(F.col("v"), d).alias("p")).collect()}
        assert got == {i: None if t is None else toggled(t, d) for i, t in enumerate(texts)}


def test_unquote(one):
    for text, want in (('"a""b"', 'a"b'), ('"', '"'), ('""', ""), ('a"b"', 'a"b"'), ("", ""), ('"b,c', '"b,c')):
        assert one(exprs.unquote, text) == want


def test_positions_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None)], "id int, t string")
    assert [tuple(r) for r in split_records(df, "t").orderBy("id", "pos").collect()] == [(1, 0, "a"), (1, 1, "b")]


@pytest.mark.parametrize(("text", "delimiter", "want"), [("a,b,", ",", ["a", "b", ""]), ("aa\r\nbb\r\ncc", "\r\n", ["aa", "bb", "cc"]), ("é,ü", ",", ["é", "ü"])])
def test_byte_ranges(spark, text, delimiter, want):
    for text, want in ((text, want), (delimiter.join([text] * 400), want * 400), (delimiter.join([text, "\x01\x02\x03", *map(chr, range(14, 32))] * 90), [*want, "\x01\x02\x03", *map(chr, range(14, 32))] * 90)):
        rows = byte_ranges(spark.createDataFrame([(1, text)], "id int, t string"), "t", delimiter).orderBy("pos").collect()
        assert [text.encode()[r["byte_start"] : r["byte_end"]].decode() for r in rows] == [r["value"] for r in rows] == want


def test_search(one):
    assert one(lambda c: exprs.search(c, ","), "ab,cd,ef") == 2
    assert one(lambda c: exprs.search(c, ",", 3), "ab,cd,ef") == 5
    assert one(lambda c: exprs.search(c, ",", 0, 2), "ab,cd") == -1
    assert one(lambda c: exprs.search(c, ",", 0, 3), "ab,cd") == 2
    assert one(lambda c: exprs.search_matches(c, ",", "**"), "ab**cd,ef") == [(2, 1), (6, 0)]
    assert one(lambda c: exprs.search_matches(c, ","), "") == []
    for n in (3, 300, 9000):
        assert one(lambda c: exprs.search_matches(c, "aa", "x"), "aaaéx🙂" * n) == [(6 * k + o, p) for k in range(n) for o, p in ((0, 0), (4, 1))]


def test_logical_rows(spark):
    lines = 'h\n"a\nx",b\n\nc,"d'.split("\n")
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate(lines)], "g int, pos int, value string")
    got = [r["value"] for r in logical_rows(df, ["pos"], ["g"]).orderBy("row").collect()]
    assert got == ["h", '"a\nx",b', "", 'c,"d']


def test_delimiters():
    assert parse_delimiter(Delimiters.Tab) == "\t"
    assert parse_delimiter(b"\r\n") == "\r\n"
    assert parse_delimiter([44, 44]) == ",,"
    assert delimiter_bytes(200) == b"\xc8" and delimiter_bytes("é", "latin-1") == b"\xe9" and delimiter_bytes([255, 0]) == b"\xff\x00"
    for bad in ("", b"", 256, -1, 200, b"\xff"):
        with pytest.raises(ValueError):
            parse_delimiter(bad)
    with pytest.raises(TypeError):
        parse_delimiter(1.5)
    with pytest.raises(ValueError):
        exprs.split_quoted(None, 'a"')


def test_running_sums(one):
    for n in (0, 1, 15, 16, 17, 255, 257, 4097, 70_000):
        numbers = [k * k % 11 for k in range(n)]
        total, want = 0, []
        for x in numbers:
            want.append(total)
            total += x
        assert one(lambda c: exprs.running_sums(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))), ",".join(map(str, numbers))) == want


def test_binary_records(spark):
    df = spark.createDataFrame([(1, b"a\xff\x00b\xff\xffc\xe9"), (2, b""), (3, None)], "id int, t binary")
    rows = lambda d, **o: [(r["id"], r["pos"], bytes(r["value"])) for r in split_records(df, "t", d, **o).orderBy("id", "pos").collect()]
    assert rows(0xFF) == rows(b"\xff") == [(1, 0, b"a"), (1, 1, b"\x00b"), (1, 2, b"c\xe9")]
    assert rows(b"\xff\xff", skip_empty=False) == [(1, 0, b"a\xff\x00b"), (1, 1, b"c\xe9"), (2, 0, b"")]


def test_visible(one):
    assert one(exprs.visible_characters, "a,b\tc\r\n \x1e") == "a-b␉c␍␤␠␞"
