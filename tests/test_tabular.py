import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.operators import jsonl, tabular

#: Weather stations: a header in every case, a quoted cell with a comma, an empty one, prices with a sign.
STATIONS = 'Station Name,openedIn,Height,FEE\nRidge,1931,812 m,"€1.25"\n"Lake, north ☂",,44 m,€7\n'


def docs(spark, text):
    return spark.createDataFrame([(text,)], "doc string")


def objects(spark, text, **options):
    return [r.asDict() for r in tabular.parse_documents(docs(spark, text), "doc", mode="object", **options).orderBy("pos").drop("pos").collect()]


def scanned(text, quotes):
    """Objects of a document, read one character after the other: rows end at line feeds, cells at commas, outside quotes."""
    rows, inside = [[""]], False
    for c in text:
        if not inside and c == "\n":
            rows[-1][-1] = rows[-1][-1].removesuffix("\r")
            rows.append([""])
        elif not inside and c == ",":
            rows[-1].append("")
        else:
            inside ^= quotes and c == '"'
            rows[-1][-1] += c
    bare = lambda c: c[1:-1].replace('""', '"') if quotes and len(c) > 1 and c[0] == c[-1] == '"' else c
    rows = [[bare(c) for c in r] for r in rows if r != [""]]
    out = []
    for r in rows[1:]:
        cells = r + [""] * (len(rows[0]) - len(r))
        keys = rows[0] + [f"column_{k}" for k in range(len(rows[0]), len(cells))]
        out.append(dict(zip(keys, cells, strict=True)))
    return out


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["k", "4.5", "", "é u", '"p,q"', '"r\ns"', '"t""u"', '"v', 'w"']), min_size=1, max_size=4), min_size=1, max_size=5), st.sampled_from(["\n", "\r\n"]), st.booleans())
def test_objects_are_what_a_scan_finds(spark, rows, end, quotes):
    text = end.join(",".join(r) for r in [["one", "two"], *rows]) + end
    want = scanned(text, quotes)
    names = list(dict.fromkeys(n for r in want for n in r))
    assert objects(spark, text, quotes=quotes, normalize_keys=False) == [{n: r.get(n, "") for n in (names or ["one", "two"])} for r in want]


def test_objects_of_little(spark):
    assert objects(spark, "one,two\n") == objects(spark, "") == objects(spark, "\n\n") == []
    assert objects(spark, '"one,1",two\n5\n', quotes=True, normalize_keys=False) == [{"one,1": "5", "two": ""}]


def test_headers_are_normalised(spark):
    got = objects(spark, STATIONS, quotes=True)
    assert list(got[0]) == ["station_name", "opened_in", "height", "FEE"]
    assert got[1]["station_name"] == "Lake, north ☂" and got[1]["opened_in"] == ""
    assert objects(spark, STATIONS)[1]["column_4"] == "€7"


def test_every_document_has_its_own_header(spark):
    texts = ["id,Name\n1,x\n2\n", "name,other\ny,z,extra\n", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, doc string")
    got = tabular.parse_documents(df, "doc", mode="object")
    assert got.columns == ["id", "pos", "id_2", "name", "other", "column_2"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(0, 0, "1", "x", None, ""), (0, 1, "2", "", None, ""), (1, 0, None, "y", "z", "extra")]
    entries = tabular.parse_documents(df, "doc", mode="entries", transformers=[F.upper]).orderBy("id", "pos").collect()
    assert [[tuple(e) for e in r["row"]] for r in entries][1:] == [[("id", "2", 0), ("name", "", 1)], [("name", "Y", 0), ("other", "z", 1), ("column_2", "extra", 2)]]
    maps = tabular.parse_documents(df, "doc", mode="object", ragged="map").orderBy("id", "pos").collect()
    assert maps[2]["row"] == {"name": "y", "other": "z", "column_2": "extra"}
    named = tabular.parse_documents(df, "doc", mode="object", names=["a", "b"], drop=1).collect()
    assert [tuple(r) for r in named] == [(0, 1 - 1, "2", "")]


def test_headerless(spark):
    assert objects(spark, "x,y\n", header=False) == [{"column_0": "x", "column_1": "y"}]


def test_array_mode_take_counts_rows(spark):
    rows = tabular.parse_documents(docs(spark, "h\nr1\nr2\nr3\n"), "doc", take=1)
    assert [r["row"] for r in rows.collect()] == [["r1"]]


def test_entries(spark):
    rows = tabular.parse_documents(docs(spark, "a,b\n1,2\n"), "doc", mode="entries")
    assert [tuple(e) for e in rows.first()["row"]] == [("a", "1", 0), ("b", "2", 1)]


@pytest.mark.parametrize(("d", "text"), [("\t", "a\tb\tc\td\te\n1\t\t\t\t5\n"), ("|", "a|b|c|d|e\n1||||5\n")])
def test_empty_cells_stay(spark, d, text):
    rows = tabular.parse_documents(docs(spark, text), "doc", header=False, column_delimiter=d).orderBy("pos").collect()
    assert [r["row"] for r in rows] == [list("abcde"), ["1", "", "", "", "5"]]


def test_wide_rows(spark):
    text = "\r\n".join(",".join(str(k * c) for c in range(640)) for k in range(12))
    rows = tabular.parse_documents(docs(spark, text), "doc", header=False).orderBy("pos").collect()
    assert [len(r["row"]) for r in rows] == [640] * 12 and rows[11]["row"][639] == str(11 * 639)


def test_transformers_by_name_and_place(spark):
    price = lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double")
    assert [r["FEE"] for r in objects(spark, STATIONS, quotes=True, transformers={"FEE": price})] == [1.25, 7.0]
    assert objects(spark, "a,b\nx,y\n", transformers=[F.upper])[0] == {"a": "X", "b": "y"}


def test_last_of_equal_names_stays(spark):
    assert objects(spark, "a,a\n1,2\n", normalize_keys=False) == [{"a": "2"}]
    assert objects(spark, "a,a\n1,2\n") == [{"a": "1", "a_2": "2"}]


def test_json_rows(spark):
    rows = spark.createDataFrame([(0, '{"a":1}'), (1, '{"a":2}')], "pos long, value string")
    assert [r["a"] for r in jsonl.parse_json_rows(rows).select(F.variant_get("json", "$.a", "int").alias("a")).collect()] == [1, 2]
    bad = spark.createDataFrame([(0, "{}"), (1, "{x")], "pos long, value string")
    with pytest.raises(Exception, match="Failed to parse JSON at row 1"):
        jsonl.parse_json_rows(bad).select(F.to_json("json")).collect()
    out = jsonl.to_json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"]
    assert out == '{"a":1,"b":null}'


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text('a",\n |é', max_size=8), min_size=3, max_size=3), min_size=1, max_size=20))
def test_quoted_cells_round_trip(spark, rows):
    quoted = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows)
    got = tabular.parse_documents(docs(spark, "a,b,c\n" + quoted + "\n"), "doc", quotes=True).orderBy("pos").collect()
    assert [r["row"] for r in got] == rows
