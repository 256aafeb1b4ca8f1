import io
import os
import random

import pytest
from pyspark.sql import functions as F

from linewright import cli
from linewright.operators import segments
from linewright.operators.jsonl import to_json_rows
from linewright.sources import chunks, datasource, files, sinks
from linewright.streaming import lines as streaming


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def values(df):
    return [r["value"] for r in df.orderBy("_file", "_pos").collect()]


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, several to a task."""
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "12"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brute(data, delimiter, quotes, crlf, skip_empty):
    """The records of a file's bytes, one byte after the other."""
    parts, inside, at = [b""], False, 0
    while at < len(data):
        if not inside and data.startswith(delimiter, at):
            parts.append(b"")
            at += len(delimiter)
            continue
        inside ^= quotes and data[at] == 34
        parts[-1] += data[at : at + 1]
        at += 1
    if crlf:
        parts = [x[:-1] if x.endswith(b"\r") else x for x in parts[:-1]] + parts[-1:]
    return [x for x in parts if x or not skip_empty]


@pytest.mark.parametrize(("delimiter", "quotes"), [(b"\n", False), (b"\x9f\x80", False), (b"||", False), (b"\n", True), (b"\xff", True), (b"\r\n", True)])
def test_files_are_read_as_byte_by_byte(spark, tmp_path, tiny_splits, quotes, delimiter):
    rng = random.Random(f"{quotes}{delimiter}")
    tokens = [b"a", b"long words here", b",", b"\r", delimiter, delimiter, delimiter + delimiter, "é".encode()] + [b'"', b'"x"'] * quotes
    contents = {f"f{k}.txt": b"".join(rng.choice(tokens) for _ in range(n)) for k, n in enumerate((1, 3, 9, 20, 40, 60))} | {"none": b"", "ends.txt": b"x\r" + delimiter + b"\r"}
    for name, data in contents.items():
        write(tmp_path / name, data)
    for crlf, skip_empty in ((False, True), (True, True), (False, False), (True, False)):
        rows = files.read_delimited(spark, str(tmp_path), delimiter, quotes=quotes, crlf=crlf, skip_empty=skip_empty)
        got = {}
        for r in rows.select("_file", "_pos", F.col("value").cast("binary").alias("value")).orderBy("_file", "_pos").collect():
            own = got.setdefault(os.path.basename(r["_file"]), [])
            assert r["_pos"] == len(own)
            own.append(bytes(r["value"]))
        assert got == {name: want for name, data in contents.items() if (want := brute(data, delimiter, quotes, crlf, skip_empty))}


def test_a_joined_table_of_splits_gives_the_same(spark, tmp_path, tiny_splits, monkeypatch):
    monkeypatch.setattr(files, "BROADCAST_SPLITS", 0)
    data = b'one,"two\nlines"\n' * 30 + b'\n"open\n'
    path = write(tmp_path / "rows", data)
    for quotes in (False, True):
        assert [x.encode() for x in values(files.read_delimited(spark, path, quotes=quotes))] == brute(data, b"\n", quotes, False, True)


def test_settings_may_change_before_the_files_are_read(spark, tmp_path, tiny_splits):
    path = write(tmp_path / "rows", "".join(f"entry {k * 7}\n" for k in range(300)))
    rows = files.read_delimited(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    assert values(rows) == [f"entry {k * 7}" for k in range(300)]
    assert values(files.read_delimited(spark, path, drop=2, take=3)) == ["entry 14", "entry 21", "entry 28"]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("[value#")


def test_every_file_has_its_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "first,second\n1,2\n3\n")
    write(tmp_path / "b.csv", "second,first,Third Name\r\n4,5,6\r\n7,8,9,10\r\n")
    write(tmp_path / "c.csv", "")
    for quotes in (False, True):
        rows = files.read_csv(spark, str(tmp_path), quotes=quotes)
        assert scans(rows) == 1
        assert rows.columns == ["_file", "_pos", "first", "second", "third_name", "column_3"]
        got = sorted((tuple(r)[1:] for r in rows.collect()), key=str)
        assert got == sorted([(0, "1", "2", None, ""), (1, "3", "", None, ""), (0, "5", "4", "6", ""), (1, "8", "7", "9", "10")], key=str)
        entries = files.read_csv(spark, str(tmp_path), quotes=quotes, mode="entries", take=1, transformers={"first": lambda c: F.concat(c, F.lit("!"))}).orderBy("_file").collect()
        assert [[tuple(e) for e in r["row"]] for r in entries] == [[("first", "1!", 0), ("second", "2", 1)], [("second", "4", 0), ("first", "5!", 1), ("third_name", "6", 2)]]
        assert "column_3" not in files.read_csv(spark, str(tmp_path), quotes=quotes, ragged="drop").columns
    maps = files.read_csv(spark, str(tmp_path / "b.csv"), ragged="map", normalize_keys=False, drop=1).first()["row"]
    assert maps == {"second": "7", "first": "8", "Third Name": "9", "column_3": "10"}


def test_quoted_files_with_headers(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    cells = ["".join(rng.choice('ab\n,"') for _ in range(rng.randint(0, 90))) for _ in range(25)]
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    body = "".join(f"{k},{quote(c)}\n" for k, c in enumerate(cells))
    rows = files.read_csv(spark, write(tmp_path / "q.csv", "\n" + quote("The\nbody of " + "x" * 100) + ",n\n" + body), quotes=True)
    assert rows.columns == ["_file", "_pos", f"the_body_of_{'x' * 100}", "n"] and scans(rows) == 2
    assert [tuple(r)[1:] for r in rows.orderBy("_pos").collect()] == [(k, str(k), c) for k, c in enumerate(cells)]
    plain = files.read_csv(spark, write(tmp_path / "p.csv", "k,c\n" + "".join(f"{k},x{k}\n" for k in range(30)) + "30,y,z\n"), quotes=True)
    assert scans(plain) == 1 and plain.where("column_2 = 'z'").count() == 1 and plain.count() == 31
    wide = files.read_csv(spark, write(tmp_path / "w.csv", "k||c\n1||" + quote("a||b") + "||c\n"), quotes=True, column_delimiter="||")
    assert [tuple(r)[2:] for r in wide.collect()] == [("1", "a||b", "c")]


def test_names_of_other_columns_stay(spark, tmp_path):
    got = files.read_csv(spark, write(tmp_path / "n.csv", "_pos,a,A\n5,6,7\n"), normalize_keys=False)
    assert got.columns == ["_file", "_pos", "_pos_2", "a", "A_2"] and tuple(got.first())[1:] == (0, "5", "6", "7")


def test_encodings_of_files(spark, tmp_path):
    latin = write(tmp_path / "l.txt", "né\nß".encode("latin-1"))
    assert values(files.read_delimited(spark, latin, encoding="iso-8859-1")) == ["né", "ß"]
    assert values(files.read_delimited(spark, latin, "é", encoding="iso-8859-1")) == ["n", "\nß"]
    assert values(files.read_delimited(spark, latin, encoding="utf-8")) == ["n\ufffd", "\ufffd"]
    with pytest.raises(Exception, match="INVALID_UTF8"):
        files.read_delimited(spark, latin, encoding="utf-8", fatal=True).collect()
    marked = write(tmp_path / "m.txt", b"\xef\xbb\xbfa\n\xef\xbb\xbfb")
    assert values(files.read_delimited(spark, marked, encoding="utf-8")) == ["a", "b"]
    assert values(files.read_delimited(spark, marked, encoding="utf-8", ignore_bom=True)) == ["\ufeffa", "\ufeffb"]
    wide = write(tmp_path / "w.csv", "k;v\n1;ü\n".encode("utf-16-le"))
    assert files.read_csv(spark, wide, encoding="utf-16le", column_delimiter=";").select("k", "v").collect() == [("1", "ü")]
    with pytest.raises(ValueError, match="quotes"):
        files.read_delimited(spark, wide, encoding="utf-16le", quotes=True)
    assert [r["json"]["a"] for r in files.read_jsonl(spark, write(tmp_path / "j", '{"a":"é"}\n'.encode("latin-1")), schema="struct<a:string>", encoding="latin1").collect()] == ["é"]


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("a\n\nb\n", {}, ["a", "b"]),
        ("a\n\nb\n", {"skip_empty": False}, ["a", "", "b", ""]),
        ("a\n\nb", {"skip_empty": False}, ["a", "", "b"]),
        ("", {"skip_empty": False}, [""]),
        ("a\rb\n", {}, ["a\rb"]),
        ("a\r\nb\r\n", {"crlf": True}, ["a", "b"]),
        ("a\r\nb\r", {"crlf": True}, ["a", "b\r"]),
        ("a␞b␞c", {"delimiter": "␞"}, ["a", "b", "c"]),
    ],
)
def test_read_delimited(spark, tmp_path, text, options, want):
    assert values(files.read_delimited(spark, write(tmp_path / "f.txt", text), **options)) == want


def test_csv_tsv_psv_jsonl_files(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Item Name,PRICE\r\nx,1\r\n"y,z",2\r\n')
    got = files.read_csv(spark, path, quotes=True).orderBy("_pos").collect()
    assert [(r["item_name"], r["PRICE"]) for r in got] == [("x", "1"), ("y,z", "2")]
    assert [r["row"] for r in files.read_tsv(spark, write(tmp_path / "b.tsv", "a\tb\n1\t\n"), mode="array").collect()] == [["1", ""]]
    assert files.read_psv(spark, write(tmp_path / "c.psv", "a|b\n1|2\n")).select("a", "b").collect() == [("1", "2")]
    rows = files.read_jsonl(spark, write(tmp_path / "d.jsonl", '{"a":1}\n{"a":2}\n'), schema="struct<a:int>")
    assert sorted(r["json"]["a"] for r in rows.collect()) == [1, 2]


@pytest.mark.parametrize(("rows", "want"), [(["alpha", "beta", "gamma"], "alpha\nbeta\ngamma\n"), (["a", "", "b"], "a\n\nb\n"), ([], "")])
def test_writer(spark, tmp_path, rows, want):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "pos int, value string").coalesce(1)
    sinks.write_lines(df, str(tmp_path / "out"), single=True)
    parts = [p for p in os.listdir(tmp_path / "out") if p.startswith("part-")]
    assert "".join((tmp_path / "out" / p).read_text() for p in parts) == want
    assert sinks.to_array(df) == rows and list(sinks.iterate(df)) == rows


def most_written(spark, run):
    """The most rows that one task of the jobs of ``run()`` wrote to files."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        listed = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.attemptId() for s in map(listed.apply, range(listed.size()))}

    last = max(stages(), default=-1)
    run()
    tasks = [context.statusStore().taskList(k, attempt, 10_000) for k, attempt in stages().items() if k > last]
    found = [t.taskMetrics().get() for listed in tasks for t in map(listed.apply, range(listed.size())) if t.taskMetrics().isDefined()]
    return max(m.outputMetrics().recordsWritten() for m in found)


@pytest.mark.parametrize("order", [None, ["k"]])
def test_one_file_is_written_by_many_tasks(spark, tmp_path, order):
    n, path = 40_000, str(tmp_path / "out")
    df = spark.range(n, numPartitions=8).select((n - 1 - F.col("id")).alias("k"), F.concat(F.col("id").cast("string"), F.lit("é,"), F.repeat(F.lit("x"), 1000)).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert 0 < most_written(spark, lambda: sinks.write_lines(df, path, order=order, single=True, delimiter="||")) < n / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    [part] = [p for p in os.listdir(path) if p.startswith("part-")]
    assert sorted(p for p in os.listdir(path) if p != part) == ["_SUCCESS"] and os.listdir(tmp_path) == ["out"]
    ids = range(n) if order is None else range(n - 1, -1, -1)
    assert (tmp_path / "out" / part).read_text(encoding="utf-8") == "".join(f"{k}é,{'x' * 1000}||" for k in ids)


def test_one_file_in_a_folder_that_is_there(spark, tmp_path):
    path, df = f"file://{tmp_path}/o u%t", spark.createDataFrame([("a",), (None,), ("",)], "value string")
    held = lambda: sorted((tmp_path / "o u%t" / p).read_text() for p in os.listdir(tmp_path / "o u%t") if p.startswith("part-"))
    sinks.write_lines(df, path, single=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_lines(df, path, single=True)
    sinks.write_lines(df, path, single=True, mode="ignore")
    assert held() == ["a\n\n"]
    sinks.write_lines(df, path, single=True, mode="append", delimiter=";")
    assert held() == ["a\n\n", "a;;"]
    sinks.write_lines(df.limit(0), path, single=True, mode="overwrite")
    assert held() == [""] and os.listdir(tmp_path) == ["o u%t"]


def test_pieces_of_one_file():
    for sizes in ([0], [5, 0, 7, 1, 1, 30], [3] * 20, [16, 16], []):
        parts = [(str(k), n) for k, n in enumerate(sizes)]
        groups = sinks._pieces(parts, 8)
        flat = [p for g in groups for p in g]
        want = [(str(k), at) for k, n in enumerate(sizes) for at in range(n)]
        assert [(name, start + i) for name, start, _, n in flat for i in range(n)] == want
        assert [at + i for _, _, at, n in flat for i in range(n)] == list(range(len(want)))
        assert all(sum(n for *_, n in g) <= 8 for g in groups)


def test_segments(tmp_path):
    path = write(tmp_path / "lines", "".join(f"{'z' * (i % 23)};{i * i}\n" for i in range(700)))
    data = open(path, "rb").read()
    for k in (1, 3, 11):
        found = segments.compute_segments(path, k)
        assert found[0][0] == 0 and found[-1][1] == len(data) and len(found) <= k
        assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert all(data[e - 1 : e] == b"\n" for _, e in found)
    assert segments.compute_segments(write(tmp_path / "s", "a\nb\nc\n"), 1) == [(0, 6)]
    assert segments.compute_segments(write(tmp_path / "e", ""), 4) == []
    assert len(segments.compute_segments(write(tmp_path / "l", "x" * 5000 + "\n" + "y" * 5000 + "\n"), 4, probe_size=1024)) < 4
    ten = write(tmp_path / "ten", "0123456789")
    assert (segments.read_bytes(ten, 3, 4), segments.read_bytes(ten, 8, 100), segments.read_bytes(ten, 20, 1)) == (b"3456", b"89", b"")


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    raw = b"".join(b"r\xff%d\r\n" % i for i in range(500)) + b"\r\nlast"
    path = write(tmp_path / "raw", raw)
    for k in (1, 3, 7):
        rows = spark.read.format("delimited").options(delimiter="\r\n", concurrency=str(k)).load(path).orderBy("byte_start").collect()
        assert [bytes(r["value"]) for r in rows] == [x for x in raw.split(b"\r\n") if x]
        assert all(raw[r["byte_start"] : r["byte_end"]] == bytes(r["value"]) for r in rows)
    kept = spark.read.format("delimited").options(delimiter="\r\n", concurrency="3", skipEmpty="false").load(path)
    assert kept.count() == 502
    empty = spark.read.format("delimited").option("skipEmpty", "false").load(write(tmp_path / "none", ""))
    assert [bytes(r["value"]) for r in empty.collect()] == [b""]
    folder = tmp_path / "several"
    folder.mkdir()
    for name, data in (("b.log", b"3\xff4\xff"), ("a.log", b"1\xff\"2\xff\"\xff"), ("_no.log", b"5"), ("c.txt", b"6")):
        write(folder / name, data)
    load = lambda path, **o: [bytes(r["value"]) for r in spark.read.format("delimited").options(delimiterHex="ff", **o).load(str(path)).orderBy("segment", "byte_start").collect()]
    assert load(folder, concurrency="2") == [b"1", b'"2', b'"', b"3", b"4", b"6"]
    assert load(folder / "*.log", quotes="true") == [b"1", b'"2\xff"', b"3", b"4"]
    assert load(tmp_path / "sev*" / "?.log") == load(folder / "[ab].log") and load(folder / "none*") == []
    with pytest.raises(Exception, match="missing"):
        load(tmp_path / "missing")
    straddling = list(datasource.scan(path, 0, len(raw), b"\r\n", chunk=3))
    assert [x for _, x in straddling] == raw.split(b"\r\n")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.txt", "one\r\n\r\ntwo\r\n")
    rows = streaming.read_stream(spark, str(tmp_path / "in"), crlf=True)
    streaming.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["one", "two"]
    seen = []
    chunks = streaming.split_stream(streaming.read_stream(spark, str(tmp_path / "in")), "value", "o")
    streaming.each_batch(chunks, str(tmp_path / "state2"), lambda df, n: seen.extend(r["value"] for r in df.collect())).awaitTermination()
    assert sorted(seen) == sorted(["ne\r", "tw", "\r", "\r"])


def test_streams_of_whole_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", 'k,v\r\n1,"x\r\ny"\r\n2,z\r\n')
    write(tmp_path / "in" / "b.csv", "v,k\n5,6\n")

    def got(rows, name):
        out = str(tmp_path / name)
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)

    records = streaming.read_stream(spark, str(tmp_path / "in"), quotes=True, crlf=True, drop=1, take=1)
    assert got(records, "one") == [(0, '1,"x\r\ny"'), (0, "5,6")]
    objects = streaming.read_csv_stream(spark, str(tmp_path / "in"), names=["k", "v"], quotes=True)
    assert got(objects, "two") == [(0, "1", "x\r\ny"), (0, "5", "6"), (1, "2", "z")]
    maps = streaming.read_csv_stream(spark, str(tmp_path / "in"), ragged="map", quotes=True).select(F.col("row")["k"].alias("k"))
    assert got(maps, "three") == [("1",), ("2",), ("6",)]
    with pytest.raises(ValueError, match="names"):
        streaming.read_csv_stream(spark, str(tmp_path / "in"))


def test_command_line(spark, tmp_path):
    source = write(tmp_path / "in.csv", 'Name,v\nx,1\n"y,z",2\n')
    out = io.StringIO()
    cli.run(["csv", source, "--quotes"], spark, stdout=out)
    assert out.getvalue() == '{"name":"x","v":"1"}\n{"name":"y,z","v":"2"}\n'
    cli.run(["iterate", source, str(tmp_path / "o.txt"), "-j", "|", "--drop", "1", "--take", "1"], spark)
    assert (tmp_path / "o.txt").read_text() == "x,1|"
    (tmp_path / "user.py").write_text("from pyspark.sql import functions as F\ntransform = F.upper\nfilter = lambda c: c != 'b'\n")
    out = io.StringIO()
    cli.run(["iterate", "-", "-", "-T", str(tmp_path / "user.py"), "-f", str(tmp_path / "user.py")], spark, stdin=io.BytesIO(b"a\nb\nc"), stdout=out)
    assert out.getvalue() == "A\nC\n"


def test_command_line_writes_files_by_tasks(spark, tmp_path, monkeypatch):
    """No row comes to the driver, and a file holds what standard output shows: malformed bytes, any text between."""
    n = 20_000
    source = write(tmp_path / "in", b"".join(b"%d\xff\xc3\n%s|" % (k, b"x" * 300) for k in range(n)))
    small = write(tmp_path / "small", b"\xe2\x82a||b|\xf0\x9f\x98\x80\xed\xa0\x80|")
    old = write(tmp_path / "old.txt", "y" * 10_000_000)
    os.chmod(old, 0o640)
    for join in ("\\n", "--", ""):
        out = io.StringIO()
        cli.run(["iterate", small, "-", "-s", "|", f"--join={join}"], spark, stdout=out)
        cli.run(["iterate", small, old, "-s", "|", f"--join={join}"], spark)
        assert out.getvalue() == open(old, encoding="utf-8", newline="").read()
    assert os.stat(old).st_mode & 0o777 == 0o640
    # From a file to itself, through a link; the driver gets no rows.
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", lambda *_, **__: pytest.fail("rows came to the driver"))
    os.symlink(source, tmp_path / "link")
    cli.run(["iterate", source, str(tmp_path / "link"), "-s", "|", "-j", ";"], spark)
    assert os.path.islink(tmp_path / "link")
    assert open(source, encoding="utf-8", newline="").read() == "".join(f"{k}\ufffd\ufffd\n{'x' * 300};" for k in range(n))
    assert sorted(os.listdir(tmp_path)) == ["in", "link", "old.txt", "small"]


def test_a_file_that_tasks_cannot_see(spark, tmp_path, monkeypatch):
    df = spark.range(5000, numPartitions=12).select(F.col("id").cast("string").alias("v"))
    want = "".join(f"{k}é" for k in range(5000))
    sinks.write_file(df, str(tmp_path / "here"), "v", delimiter="é")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    sinks.write_file(df, str(tmp_path / "there"), "v", delimiter="é")
    shared = sinks.scratch_path(spark, "in-shared")
    os.makedirs(sinks.local_path(spark, shared))
    monkeypatch.setattr(sinks, "_by_driver", None)
    sinks.write_file(df, sinks.local_path(spark, shared) + "/x", "v", delimiter="é")
    for name in (tmp_path / "here", tmp_path / "there", sinks.local_path(spark, shared) + "/x"):
        assert open(name, encoding="utf-8").read() == want
    assert sorted(os.listdir(tmp_path)) == ["here", "there"] and os.listdir(sinks.local_path(spark, shared)) == ["x"]


def test_jsonl_writer(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"a":1,"b":"x"}'
    assert sinks.csv_lines(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"] == "1,"
    assert to_json_rows(spark.range(1), "id").first()["value"] == '{"id":0}'
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_chunks_and_sources(spark, tmp_path):
    path = write(tmp_path / "ten", "0123456789")
    assert list(chunks.iter_chunks(path, 3)) == [b"012", b"345", b"678", b"9"]
    assert list(chunks.iter_chunks(path, 64, 2, 5)) == [b"2345"]
    assert b"".join(bytes(r["bytes"]) for r in chunks.read_chunks(spark, path, 4).orderBy("offset").collect()) == b"0123456789"
    part = lambda *a: [(r["offset"], bytes(r["bytes"])) for r in chunks.read_chunks(spark, path, *a).orderBy("offset").collect()]
    assert part(3, 2, 7) == [(2, b"234"), (5, b"567")] and part(4, 8, 99) == [(8, b"89")] and part(4, 30) == part(4, 5, 4) == []
    lines = write(tmp_path / "l.txt", "a\n\nb\n")
    get = lambda df, pos: [r["value"] for r in df.orderBy(pos).collect()]
    assert get(chunks.records_from(spark, tmp_path / "l.txt"), "_pos") == get(chunks.records_from(spark, lines), "_pos") == ["a", "b"]
    assert get(chunks.records_from(spark, b"a\nb"), "pos") == get(chunks.records_from(spark, [b"a", "\n", b"b"]), "pos") == ["a", "b"]
    assert get(chunks.parse_text(spark, "a\n\nb", skip_empty=False), "pos") == ["a", "", "b"]
    assert get(chunks.records_from(spark, spark.createDataFrame([("x,y",)], "t string"), ","), "pos") == ["x", "y"]
    with pytest.raises(OSError, match="cannot read"):
        chunks.records_from(spark, str(tmp_path / "missing"))
    with pytest.raises(TypeError):
        chunks.records_from(spark, 5)
    with sinks.NewlineWriter(str(tmp_path / "w")) as writer:
        for line in ("a", "", b"b"):
            writer.write(line)
    assert (tmp_path / "w").read_text() == "a\n\nb\n"
