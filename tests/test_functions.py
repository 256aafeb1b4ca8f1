import pytest
from pyspark.sql import functions as F

from linewright.functions import buffers, casing, exprs, ranges, text
from linewright.operators import combine, parallel


@pytest.mark.parametrize(("name", "want"), [("Item Name", "item_name"), ("PRICE", "PRICE"), ("U.S.A.", "U_S_A_"), ("fooBar", "foo_bar"), ("XMLHttpRequest", "xml_http_request"), ("", ""), ("A  B", "A_B"), ("two-words here", "two_words_here")])
def test_snake_case(one, name, want):
    assert casing.smart_snake_case(name) == want
    assert one(casing.snake_case_col, name) == want


@pytest.mark.parametrize(("name", "camel", "capital"), [("item name", "itemName", "item name"), ("Item Name", "itemName", "Item Name"), ("USA", "USA", "USA"), ("a@B.c", "aBC", "a@B.c"), ("fooBar baz", "fooBarBaz", "Foo Bar Baz")])
def test_camel_and_capital_case(one, name, camel, capital):
    assert (casing.smart_camel_case(name), casing.smart_capital_case(name)) == (camel, capital)
    assert one(casing.camel_case_col, name) == camel
    assert one(casing.capital_case_col, name) == capital


def test_uniformly_cased(one):
    for name, want in (("ABC", True), ("abc", True), ("Abc", False), ("", False), (None, False)):
        assert casing.is_uniformly_cased(name) is want
        assert one(lambda c: casing.uniformly_cased_col(c.cast("string")), name) is want


def test_normalised_names_stay_apart():
    assert casing.normalize_column_names(["a", "a", "a"]) == ["a", "a_2", "a_3"]
    assert casing.normalize_column_names(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]


def test_names_of_columns_are_normalised_alike(spark):
    for names in (["a", "a_2", "a"], ["Item Name", "itemName", "PRICE", "x", "PRICE", "PRICE_2"], [], [""] * 3):
        df = spark.createDataFrame([(names,)], "n array<string>")
        assert df.select(casing.normalize_names_col(F.col("n")).alias("o")).first()["o"] == casing.normalize_column_names(names)


def test_decode(one):
    assert one(text.decode, b"a\xff") == "a�"
    assert one(text.decode, b"\xef\xbb\xbfa") == "a"
    assert one(lambda c: text.decode(c, ignore_bom=True), b"\xef\xbb\xbfa") == "﻿a"
    assert one(lambda c: text.decode(c, "utf-16le"), "é".encode("utf-16le")) == "é"
    assert one(lambda c: text.decode(c, "latin1"), b"\x80\xe9\x81") == "€é\x81"
    every = bytes(range(256))
    for name in ("koi8-r", "iso-8859-2", "windows-1251", "macroman"):
        assert one(lambda c: text.decode(c, name), every) == every.decode(name, "replace")
    with pytest.raises(Exception, match="does not use"):
        one(lambda c: text.decode(c, "windows-1253", fatal=True), b"a\xaa")
    for name in ("shift_jis", "gbk", "none-such"):
        with pytest.raises(LookupError):
            text.decode(F.lit(b""), name)
    with pytest.raises(Exception, match="INVALID_UTF8"):
        one(lambda c: text.decode(c, fatal=True), b"a\xff")


def test_buffers(spark, one):
    chunks = spark.range(1).select(F.array(F.lit(b"ab"), F.lit(b"cd")).alias("c"))
    c = F.col("c")
    row = chunks.select(buffers.flat(buffers.prepend(c, F.lit(b"x"))).alias("p"), buffers.byte_length(c).alias("n"), buffers.flat(buffers.remove_last(c)).alias("l"), buffers.flat(buffers.remove_first(buffers.remove_first(buffers.remove_first(c)))).alias("e")).first()
    assert (bytes(row["p"]), row["n"], bytes(row["l"]), bytes(row["e"])) == (b"xabcd", 4, b"ab", b"")
    assert bytes(one(lambda v: buffers.slice_bytes(v, -3, -1), b"hello")) == b"ll"
    assert bytes(one(lambda v: buffers.read_window(v, 8, 100), b"0123456789")) == b"89"
    assert bytes(one(lambda v: buffers.subarray(v, 2, 6), b"0123456789")) == b"2345"
    for bad in (lambda v: buffers.byte_at(v, 9), lambda v: buffers.subarray(v, 1, 9)):
        with pytest.raises(Exception, match="out of"):
            one(bad, b"abc")


def test_zip_merge_batch(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "x int"), spark.createDataFrame([("y",)], "y string")
    assert [tuple(r) for r in combine.zip_rows(a, b, ["x"], ["y"]).select("x", "y", "idx").orderBy("idx").collect()] == [(1, "y", 0), (2, None, 1), (3, None, 2)]
    z = spark.range(1).select(combine.zip_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.lit("x"))).alias("z"))
    assert [tuple(s) for s in z.first()["z"]] == [(1, "x", 0), (2, None, 1)]
    assert [tuple(s) for s in z.select(combine.without_index(F.col("z")).alias("z")).first()["z"]] == [(1, "x"), (2, None)]
    assert combine.merge(a, a, a).count() == 9
    n = combine.numbered(spark.range(0, 100).select((99 - F.col("id")).alias("v")), ["v"], "pos")
    assert all(r["v"] == r["pos"] for r in n.collect())
    got = combine.batch(combine.numbered(a, ["x"], "pos"), "pos", "x", 2).orderBy("batch").collect()
    assert [r["items"] for r in got] == [[1, 2], [3]]
    with pytest.raises(ValueError):
        combine.batch(a, "x", "x", 0)


def test_user_functions(spark):
    rows = spark.range(200).withColumnRenamed("id", "v")
    assert sorted(r[0] for r in parallel.parallel_map(rows, "v", lambda v, c: int(v) * 2, "long", concurrency=3).collect()) == [2 * i for i in range(200)]
    evens = parallel.map_records(rows.coalesce(1), "v", lambda v, c: parallel.SKIP if c.index % 2 else c.user_data, "string", user_data="u")
    assert [r[0] for r in evens.collect()] == ["u"] * 100

    async def slow(v, context):
        return int(v)

    assert sorted(r[0] for r in parallel.map_records(rows, "v", slow, "long", max_in_flight=3).collect()) == list(range(200))

    def broken(v, context):
        raise ValueError(f"no answer for {v}")

    with pytest.raises(Exception, match="no answer for"):
        parallel.map_records(rows, "v", broken, "long").collect()

    async def one_fails(v, context):
        if v == 5:
            raise KeyError("five is missing")
        return await slow(v, context)

    with pytest.raises(Exception, match="five is missing"):
        parallel.map_records(rows, "v", one_fails, "long").collect()
    for handler in (slow, lambda v, c: v):
        with pytest.raises(Exception, match="Aborted"):
            parallel.map_records(rows, "v", handler, "long", abort=lambda: True).collect()
        assert parallel.map_records(rows, "v", handler, "long", abort=lambda: False).count() == 200
    lists = spark.createDataFrame([([1, 2], {"a": 1})], "x array<int>, y map<string,int>")
    assert parallel.map_records(lists, "x", lambda v, c: [k * 2 for k in v], "array<int>").first()[0] == [2, 4]


def test_search_all_and_ranges(spark, one):
    assert one(lambda c: exprs.search_all(c, ","), "a,b,") == [(0, 1), (2, 3), (4, 4)]
    assert one(lambda c: exprs.search_all(c, "\r\n"), "aa\r\nbb\r\ncc") == [(0, 2), (4, 6), (8, 10)]
    assert one(lambda c: exprs.search_all(c, ","), "") == [(0, 0)]
    assert len(one(lambda c: exprs.search_all(c, ",", 3), "," * 50)) == 3 and len(one(lambda c: exprs.search_all(c, ","), "," * 5000)) == 5001
    q = ranges.enqueue(ranges.enqueue(ranges.queue(), 1, 4), 6, 7)
    row = spark.range(1).select(ranges.peek(q).alias("a"), ranges.peek_last(q).alias("b"), ranges.byte_length(q).alias("n"), ranges.dequeue(q).alias("d"), ranges.peek(ranges.queue()).alias("none")).first()
    assert (tuple(row["a"]), tuple(row["b"]), row["n"], [tuple(x) for x in row["d"]], row["none"]) == ((1, 4), (6, 7), 4, [(6, 7)], None)


def test_growable_buffer(one):
    assert bytes(one(lambda v: buffers.grow(v, 4), b"ab")) == b"ab\0\0"
    assert bytes(one(lambda v: buffers.set_bytes(v, F.lit(b"X"), 1), b"abc")) == b"aXc"
    assert bytes(one(lambda v: buffers.set_bytes(v, F.lit(b"XY"), 1), b"abc")) == b"aXY"
    assert bytes(one(buffers.clear, b"ab")) == b"\0\0"
    with pytest.raises(Exception, match="out of bounds"):
        one(lambda v: buffers.set_bytes(v, F.lit(b"XY"), 2), b"abc")
