"""Lines of text, the command line, streaming queries, registered queries."""

import io
import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from streamspec import cli, queries
from streamspec.analysis.checker import check
from streamspec.plans.batch import evaluate
from streamspec.sinks import text
from streamspec.sources import csv
from streamspec.streaming import online

SPEC = 'input a: Int64\noutput b := a + 1\noutput c @1Hz := a.hold(or: 0)\ntrigger b > 2 "big"\ntrigger c > 1'
DATA = "a,time\n1,10.0\n2,11.0\n#,11.5\n3,12.0\n"


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "x.csv"
    path.write_text(DATA)
    spec = check(SPEC)
    trace = csv.read(spark, str(path), spec)
    return evaluate(spec, trace.df), trace.start, str(path)


def test_lines(result):
    res, start, _ = result
    got = [r.line for r in text.lines(res, start, "absolute").collect()]
    assert got == ["11.000000000: Trigger: big", "11.000000000: Trigger: c > 1", "12.000000000: Trigger: big", "12.000000000: Trigger: c > 1"]
    assert [r.line for r in text.lines(res, start).collect()][0] == "Trigger: big"
    assert text.lines(res, start, "relative_nanos").first().line.startswith("1000000000: ")
    assert text.lines(res, start, "relative_human").first().line.startswith("1s: ")
    assert text.lines(res, start, "absolute_human").first().line.startswith("1970-01-01T00:00:11Z: ")
    got = [r.line for r in text.lines(res, start, "relative", "outputs").collect()]
    assert got[:2] == ["0.000000000: OutputStream[0] := 2.", "0.000000000: OutputStream[1] := 1."] and len(got) == 10
    assert text.lines(res, start, verbosity="silent").count() == 0


def test_human_times():
    assert text.human(0) == "0s" and text.human(90_061_000_000_123) == "1day 1h 1m 1s 123ns" and text.rfc3339(1_500_000_000) == "1970-01-01T00:00:01.500000000Z"


def test_channels(result, capsys, tmp_path, spark):
    res, start, _ = result
    text.show(res, start, channel="stdout", verbosity="progress")
    assert "2 x big (7 cycles)" in capsys.readouterr().out
    text.show(res, start, channel="none")
    text.show(res, start, channel="file", path=str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 4


def test_statistics_and_log(result):
    res, _, _ = result
    assert [(r.message, r.fired, r.cycles) for r in res.statistics().orderBy("trigger").collect()] == [("big", 2, 7), ("c > 1", 2, 7)]
    assert res.log().where("stream = 'c'").orderBy("ts").select("value").collect()[2].value == "3"
    assert [r.value for r in res.stream("b").orderBy("ts").collect()] == [2, 3, 4]
    assert res.values("b", "c").columns == ["ts", "kind", "seq", "b", "c"]


def test_streams_may_be_named_like_times(spark, tmp_path):
    (tmp_path / "n.csv").write_text("ts,kind,seq\n1.5,7,8\n2.5,#,9\n")
    spec = check("input ts: Float64, kind: Int64, seq: Int64\noutput x := ts + 1.0\noutput y := kind + seq")
    res = evaluate(spec, csv.read(spark, str(tmp_path / "n.csv"), spec).df)
    assert [(r.x, r.y) for r in res.values().orderBy("__ts").collect()] == [(2.5, 15), (3.5, None)]


def test_command_line(result, tmp_path, capsys):
    _, _, path = result
    (tmp_path / "s.spec").write_text(SPEC)
    (tmp_path / "bad.spec").write_text("output x := y")
    assert cli.main(["monitor", str(tmp_path / "s.spec"), "--csv-in", path, "--stdout", "--time-info-rep", "relative"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "1.000000000: Trigger: big"
    assert cli.main(["analyze", str(tmp_path / "s.spec")]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["outputs"]["c"]["clock"] == "1Hz" and got["bytes"] > 0
    assert cli.main(["analyze", str(tmp_path / "s.spec"), "pretty-print"]) == 0
    assert "output b := a + 1" in capsys.readouterr().out
    for mode, part in (("parse", "1 inputs, 2 outputs, 2 triggers"), ("ast", '"node": "Binary"'), ("ir", '"operation": "Hold"')):
        assert cli.main(["analyze", str(tmp_path / "s.spec"), mode]) == 0
        assert part in capsys.readouterr().out
    assert cli.main(["analyze", str(tmp_path / "bad.spec")]) == 1
    assert cli.main(["infer", path]) == 0


def test_streaming_query(spark, tmp_path):
    """Files arrive one after another; the query fires what the batch run fires, but for open deadlines."""
    spec = 'input a: Int64\noutput n := n[-1].defaults(to: 0) + a\noutput w @1Hz := a.aggregate(over: 2s, using: sum)\ntrigger n > 6 "n"\ntrigger w > 4 "w"'
    schema = "user string, __ts long, __seq long, a long"
    rows = [(u, i * 400_000_000, i, i % 5) for i in range(20) for u in ("x", "y")]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        time.sleep(0.01)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for keys in (("user",), ()):
        name = "fired" + "".join(keys)
        found = online.triggers(spec, source if keys else source.where("user = 'x'"), keys)
        query = found.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
        got = sorted((getattr(r, "user", "x"), r.ts, r.message) for r in spark.table(name).collect())
        batch = spark.createDataFrame(rows, schema).where("true" if keys else "user = 'x'")
        last = 19 * 400_000_000
        want = evaluate(spec, batch, keys).triggers().where((F.col("ts") < last) | (F.col("kind") == 0))
        assert got == sorted((getattr(r, "user", "x"), r.ts, r.message) for r in want.collect())


def test_following_from_the_command_line(result, tmp_path, capsys, monkeypatch):
    _, _, path = result
    (tmp_path / "s.spec").write_text(SPEC)
    monkeypatch.setattr("sys.stdin", io.StringIO(DATA))
    assert cli.main(["monitor", str(tmp_path / "s.spec"), "--stdin", "--stdout", "--time-info-rep", "absolute"]) == 0
    got = capsys.readouterr().out.splitlines()
    res, start, _ = result
    wanted = [r.line for r in text.lines(res, start, "absolute").collect()]
    assert got[: len(wanted)] == wanted and got[len(wanted)] == "2 x big (7 cycles)" and "ns/event" in got[-1]
    assert cli.main(["monitor", str(tmp_path / "s.spec"), "--csv-in", path, "--online", "--stdout", "--verbosity", "outputs"]) == 0
    got = capsys.readouterr().out.splitlines()
    assert [x for x in got if x.startswith("OutputStream[0]")] == ["OutputStream[0] := 2.", "OutputStream[0] := 3.", "OutputStream[0] := 4."]
    monkeypatch.setattr("sys.stdin", io.StringIO("a\n1\n2\n"))
    assert cli.main(["monitor", str(tmp_path / "s.spec"), "--stdin", "--output", str(tmp_path / "out"), "--verbosity", "triggers"]) == 0
    lines = (tmp_path / "out" / "lines.txt").read_text().splitlines()
    assert "Trigger: big" in lines and "1 x big" in "\n".join(lines) and "events/s" in lines[-1]


def started(frame, name, path, **trigger):
    return frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(**trigger).option("checkpointLocation", path).start()


def test_streaming_outputs_and_events_out_of_order(spark, tmp_path):
    """Outputs as well as triggers; events up to two seconds late are put in order, later ones dropped."""
    spec = 'input a: Int64\noutput n := n[-1].defaults(to: 0) + a\noutput w @1Hz := a.aggregate(over: 2s, using: sum)\ntrigger n > 30 "n"'
    schema, second = "__ts long, __seq long, a long", 10**9
    rows = [(i * second // 2, i, i % 5) for i in range(24)]
    mixed = [rows[i] for i in (0, 2, 1, 3, 5, 4, 6, 7, 9, 8, 10, 11, 14, 13, 12, 15, 16, 17, 19, 18, 20, 21, 22, 23)]
    for part in range(4):
        own = mixed[part * 6 : part * 6 + 6] + ([(second, 99, 1000)] if part == 3 else [])
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        time.sleep(0.01)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    progress = online.Progress()
    spark.streams.addListener(progress)
    try:
        query = started(online.run(spec, source, late="drop", wait=2 * second), "late", str(tmp_path / "late"), availableNow=True)
        query.awaitTermination()
        got = {(r.ts, r.kind, r.stream, r.trigger, r.value) for r in spark.table("late").collect()}
        batch = evaluate(spec, spark.createDataFrame(rows, schema))
        last = rows[-1][0] - 2 * second
        want = {(r.ts, r.kind, r.stream, None, r.value) for r in batch.log().collect() if r.ts < last or r.ts == last and r.kind == 0}
        want |= {(r.ts, r.kind, None, r.trigger, r.message) for r in batch.triggers().collect() if r.ts <= last}
        assert got == want
        for _ in range(100):
            if progress.events >= 25:
                break
            time.sleep(0.1)
        assert progress.events == 25 and "events/s" in progress.line()
    finally:
        spark.streams.removeListener(progress)
    strict = started(online.run(spec, source), "strict", str(tmp_path / "strict"), availableNow=True)
    with pytest.raises(Exception, match="comes after"):
        strict.awaitTermination()


def test_streaming_deadlines_by_the_clock_and_idle_keys(spark, tmp_path):
    """Timers evaluate deadlines while no event comes; a key without events ends, and starts anew."""
    spec = "input a: Int64\noutput n @200ms := a.hold(or: 0)\noutput e := e[-1].defaults(to: 0) + 1"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("user string, a long").json(str(tmp_path / "in"))
    start = int(time.time() * 10**6)
    query = started(online.run(spec, online.arrived(source, start), ("user",), start=start, idle=4000), "clocked", str(tmp_path / "clocked"), processingTime="100 milliseconds")

    def rows(where):
        return spark.table("clocked").where(where).orderBy("ts").collect()

    def until(condition, seconds=40):
        for _ in range(seconds * 5):
            if condition():
                return True
            time.sleep(0.2)
        return False

    try:
        (tmp_path / "in" / "a.json").write_text('{"user": "x", "a": 7}\n')
        assert until(lambda: rows("stream = 'e'"))
        seen = len(rows("stream = 'n' AND value = '7'"))
        assert until(lambda: len(rows("stream = 'n' AND value = '7'")) > seen + 3)
        time.sleep(6)  # idle: the key ends
        (tmp_path / "in" / "b.json").write_text('{"user": "x", "a": 8}\n')
        assert until(lambda: len(rows("stream = 'e'")) == 2)
        assert [r.value for r in rows("stream = 'e'")] == ["1", "1"]
    finally:
        query.stop()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cursor = duck.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cursor.description]
    order = sorted(cols)
    assert sorted(frame.columns) == order

    def plain(v):
        return repr(round(v, 6)) if isinstance(v, float) else repr(v)

    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in frame.collect()) == want
