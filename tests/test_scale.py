"""What keeps tasks small: chunks of bursts and of frequent keys, windows of any period."""

import random

import pytest
from pyspark.sql import functions as F

from streamspec.analysis.checker import check
from streamspec.operators import timeline
from streamspec.operators.timeline import CHUNK
from streamspec.plans.batch import evaluate

SPEC = """import math
input a: Int64
input b: Float64
output s := s[-1].defaults(to: 0) + a
output n @(a || b) := n[-1].defaults(to: 0) + 1
output last @b := a.hold().defaults(to: -1)
output far := a[-7].defaults(to: 0)
output two := b[-2].defaults(to: 0.0)
output top := max(top[-1].defaults(to: -99), a)
output at @1s := a.hold().defaults(to: 0)
output w @1s := a.aggregate(over: 4s, using: sum)
output i @2s := b.aggregate(over: 3s, using: integral)
"""
NAMES = ("s", "n", "last", "far", "two", "top", "at", "w", "i")
KINDS = "key string, __ts bigint, __seq bigint, a bigint, b double"


def rows_of(result, keys=()):
    got = result.line.df.select(*keys, "__ts", "__kind", "__seq", *[F.col(f"`{n}`").alias(n) for n in NAMES]).collect()
    return {tuple(r[k] for k in (*keys, "__ts", "__kind", "__seq")): {n: round(r[n].v, 9) for n in NAMES if r[n] is not None and r[n].v is not None} for r in got}


def events(r, n, key=lambda r: "k"):
    """Events with pauses and bursts: many at one instant."""
    ts, out = 0, []
    for i in range(n):
        ts += r.choice([0] * 6 + [10**8, 4 * 10**8]) if not n // 3 < i < 2 * n // 3 else 0
        out.append((key(r), ts, i, r.choice([None, r.randint(-9, 9)]), r.choice([None, r.randint(-40, 40) / 8])))
    return out


@pytest.mark.parametrize("chunk_rows", [20, 70])
def test_an_instant_with_more_rows_than_a_chunk_is_cut(spark, chunk_rows):
    trace = spark.createDataFrame(events(random.Random(chunk_rows), 300), KINDS).repartition(3)
    one, many = (evaluate(SPEC, trace, chunk_rows=c) for c in (10**6, chunk_rows))
    assert rows_of(one) == rows_of(many)
    sizes = [r["count"] for r in many.line.df.groupBy(CHUNK).count().collect()]
    assert max(sizes) <= 3 * chunk_rows and len(sizes) > 300 // (2 * chunk_rows)
    order = many.line.df.groupBy(CHUNK).agg(F.min(F.struct("__ts", "__kind", "__seq")).alias("x"), F.max(F.struct("__ts", "__kind", "__seq")).alias("y")).orderBy(CHUNK).collect()
    assert all(p.y < q.x for p, q in zip(order, order[1:], strict=False))


def test_a_frequent_key_has_many_chunks(spark):
    r = random.Random(5)
    rows = events(r, 400, lambda r: r.choice(["hot"] * 8 + ["rare", "none"]))
    trace = spark.createDataFrame(rows, KINDS).repartition(3)
    one, many = (evaluate(SPEC, trace, ("key",), chunk_rows=c) for c in (10**6, 30))
    assert rows_of(one, ("key",)) == rows_of(many, ("key",))
    assert max(x["count"] for x in many.line.df.groupBy("key", CHUNK).count().collect()) <= 90
    # Each key is a trace of its own, over the times of all.
    last = max(x[1] for x in rows)
    for key in ("hot", "rare"):
        alone = spark.createDataFrame([x for x in rows if x[0] == key] + [("end", last, 10**6, None, None)], KINDS)
        got = {k[1:]: v for k, v in rows_of(one, ("key",)).items() if k[0] == key}
        want = {k: v for k, v in rows_of(evaluate(SPEC, alone)).items() if k[2] != 10**6}
        assert got == want


def test_deadlines_of_keys_without_a_cross_join(spark, monkeypatch):
    monkeypatch.setattr(timeline, "SPAN", 7)
    rows = events(random.Random(6), 90, lambda r: r.choice("xyz"))
    res = evaluate(SPEC, spark.createDataFrame(rows, KINDS), ("key",))
    last = max(x[1] for x in rows)
    got = sorted((r.key, r["__ts"]) for r in res.line.df.where("__kind = 1").collect())
    assert got == sorted((k, t) for k in {x[0] for x in rows} for t in range(0, last + 1, 10**9))
    plan = res.line.df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


LINEAR = """constant m: Int64 := 97
input a: Int64
input b: Float64
output x := (x[-1].defaults(to: 5) * 31 + a) % 1009
output y := (7 + y[-1].defaults(to: 0) * (a + 2)) % m
output z @(a || b) := (z[-1].defaults(to: 1) * 3 + 1) % 11
output negative := (negative[-1].defaults(to: 3) * 2 - 20) % 7
output twice := twice[-1].defaults(to: 1) * twice[-2].defaults(to: 2) % 13
"""


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_remainders_of_linear_recursions_run_by_chunks(spark, keys, monkeypatch):
    from streamspec.operators import recursion

    folded, own = [], recursion.folded
    monkeypatch.setattr(recursion, "folded", lambda line, spec, group, *a: (folded.append(group[0].name), own(line, spec, group, *a))[1])
    r = random.Random(8)
    rows = [(k, t, i, None if a is None else abs(a), b) for k, t, i, a, b in events(r, 200, lambda r: r.choice("xxxy"))]
    trace = spark.createDataFrame(rows, KINDS).repartition(3)
    results = []
    for chunk_rows in (10**6, 25):
        folded.clear()
        line = evaluate(LINEAR, trace, keys, chunk_rows=chunk_rows).line
        results.append(sorted(map(str, line.df.select(*keys, "__ts", "__seq", "x", "y", "z", "negative", "twice").collect())))
    assert results[0] == results[1] and sorted(folded) == ["negative", "twice"]


def test_values_that_a_step_may_not_take_are_folded(spark):
    """Negative values: the remainder follows the sign of what is divided, step by step."""
    rows = [("k", i * 10**9, i, (-1) ** i * i, None) for i in range(60)]
    trace = spark.createDataFrame(rows, KINDS)
    spec = "input a: Int64\noutput x := (x[-1].defaults(to: 5) * 3 + a) % 17"
    one, many = (sorted(map(str, evaluate(spec, trace, chunk_rows=c).values("x").collect())) for c in (10**6, 9))
    assert one == many and any("x=-" in r for r in one)


WINDOWS = {
    "count": lambda v: len(v), "sum": lambda v: sum(v), "min": lambda v: min(v, default=None), "max": lambda v: max(v, default=None), "avg": lambda v: sum(v) / len(v) if v else None,
}


@pytest.mark.parametrize("period,duration", [("1ms", "1s"), ("10ms", "64ms"), ("3s", "1s"), ("250ms", "16s"), ("1s", "1s")])
@pytest.mark.parametrize("slab", [64, 4096])
def test_windows_against_all_values(spark, monkeypatch, period, duration, slab):
    """Periods far under a pane and over a window, in slabs that a window spans."""
    from streamspec.operators import sliding

    monkeypatch.setattr(sliding, "SLAB", slab)
    unit = {"ms": 10**6, "s": 10**9}
    p, d = (next(int(x.removesuffix(u)) * f for u, f in unit.items() if x.endswith(u) and x.removesuffix(u).isdigit()) for x in (period, duration))
    r, ts, rows = random.Random(p + d), 0, []
    for i in range(150):
        ts += r.choice([0, 1, d // 64, d // 7, d // 3, 3 * d]) if i and r.random() < 0.4 else 0
        rows.append((("x", "y")[i % 2], min(ts, 2500 * p), i, None, r.randint(-40, 40) / 8))
    rows.sort(key=lambda x: x[1])
    spec = "input b: Float64\n" + "\n".join(f"output {f}_ @{period} := b.aggregate(over: {duration}, using: {f})" for f in WINDOWS)
    trace = spark.createDataFrame(rows, KINDS)
    res = evaluate(spec, trace, ("key",), exact_windows=True)
    pane = d // 64
    for row in res.line.df.where("__kind = 1").collect():
        at = row["__ts"]
        own = [x[4] for x in rows if x[0] == row.key and x[1] <= at and at // pane - x[1] // pane <= 63]
        for f, fn in WINDOWS.items():
            want, got = fn(own), row[f"{f}_"].v
            assert got == want or got == pytest.approx(want, abs=1e-9), (at, f)


def test_a_window_of_many_deadlines_is_linear(spark):
    """An hour every second: rows of any step follow values and deadlines, not both multiplied."""
    from streamspec.operators.sliding import aggregate

    n, spec = 2000, check("input b: Float64\noutput w @1s := b.aggregate(over: 1h, using: sum)")
    trace = spark.range(n).select((F.col("id") * 10**9).alias("__ts"), F.col("id").alias("__seq"), F.col("id").cast("double").alias("b"))
    line = timeline.build(trace, [10**9])
    line = line.with_df(line.df.withColumn("b", F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("v")))))
    made = aggregate(line, "b", spec.windows[0], 10**9)
    assert made.count() == n and made.agg(F.max("value")).first()[0] == n * (n - 1) / 2
    made.collect()

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    done = made._jdf.queryExecution().executedPlan()
    done = done.executedPlan() if done.nodeName() == "AdaptiveSparkPlan" else done
    most = [m.get().value() for x in nodes(done) if (m := x.metrics().get("numOutputRows")).isDefined()]
    assert max(most, default=0) <= 4 * n


def test_powers_of_any_exponent(spark):
    rows = [("k", i, i, a, float(b)) for i, (a, b) in enumerate([(-1, 10**12 + 1), (1, 10**15), (0, 10**9), (2, 62), (-3, 3), (7, 0), (-1, 10**12)])]
    spec = "input a: Int64\ninput b: Float64\noutput e: Int64 := cast(b)\noutput x := a ** e"
    got = {r["__seq"]: r.x.v for r in evaluate(spec, spark.createDataFrame(rows, KINDS)).line.df.collect()}
    assert [got[i] for i in range(len(rows))] == [-1, 1, 0, 2**62, -27, 1, 1]
    with pytest.raises(Exception, match="(?i)overflow"):
        evaluate(spec, spark.createDataFrame([("k", 0, 0, 2, 64.0)], KINDS)).line.df.collect()


FOLDS = """input a: Int64
input b: Float64
output x := y[-1].defaults(to: 0) + a
output y @a := x[-2].defaults(to: 1) % 97
output z @(a || b) := (z[-3].defaults(to: 2) * 3 + y.hold(or: 1)) % 7 - z[-1].defaults(to: 1)
"""


def most_rows_of_a_task(line):
    return max(r["count"] for r in line.df.withColumn("__task", F.spark_partition_id()).groupBy("__task").count().collect())


def test_a_fold_takes_chunk_after_chunk(spark):
    """No task sorts more than a chunk, also where chunks have no value that acts."""
    rows = [("k", t, i, a if not 90 < i < 160 else None, b if not 60 < i < 190 else None) for _, t, i, a, b in events(random.Random(9), 250)]
    trace = spark.createDataFrame(rows, KINDS).repartition(3)
    one, many = (evaluate(FOLDS, trace, chunk_rows=c).line for c in (10**6, 20))
    assert many.chunks > 8 and most_rows_of_a_task(many) <= 3 * 20
    assert len({str(sorted(map(str, x.df.select("__ts", "__seq", "x", "y", "z").collect()))) for x in (one, many)}) == 1


NEAR = "input a: Int64\ninput b: Float64\n" + "".join(f"output x{i} := a[-{i}].defaults(to: 0)\noutput y{i} := b[-{i}]\n" for i in range(1, 5)) + "output z @(a || b) := x2.get()\noutput u @(a || b) := z[-3]\n"


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_offsets_reach_back_over_chunks(spark, keys):
    """Chunks with fewer values than steps, and values that are none; no task holds more than a chunk."""
    r = random.Random(12)
    rows = [(k, t, i, a if not 60 < i < 130 or i == 99 else None, b if i % 9 == 0 else None) for k, t, i, a, b in events(r, 220, lambda r: r.choice("xxxy"))]
    trace = spark.createDataFrame(rows, KINDS).repartition(3)
    one, many = (evaluate(NEAR, trace, keys, chunk_rows=c).line for c in (10**6, 15))
    names = [*(f"{n}{i}" for n in "xy" for i in range(1, 5)), "u"]
    got = [sorted(map(str, x.df.select(*keys, "__ts", "__seq", *names).collect())) for x in (one, many)]
    assert got[0] == got[1]
    if not keys:
        assert most_rows_of_a_task(many) <= 3 * 15
        past: list = []
        want = {}
        for _, t, i, a, _ in rows:
            if a is not None:
                want[i] = [past[-k] if len(past) >= k else 0 for k in range(1, 5)]
                past.append(a)
        assert {x["__seq"]: [x[f"x{k}"].v for k in range(1, 5)] for x in many.df.where("a IS NOT NULL").collect()} == want


def test_an_offset_is_one_window(spark):
    line = evaluate("input a: Int64\noutput x := a[-3].defaults(to: 0)", spark.createDataFrame([("k", i, i, i, None) for i in range(9)], KINDS)).line
    plan = line.df.select("__ts", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    assert [x.x.v for x in line.df.orderBy("__ts").collect()] == [0, 0, 0, *range(6)]


#: Deadlines of a hold, past values of an output, remainders by chunks: forms whose tasks may not grow with the trace.
TASKS = {
    "recursion": "input a: Int64\ninput b: Float64\noutput x := (x[-1].defaults(to: 1) * 31 + a) % 1009",
    "offset_of_output": "input a: Int64\ninput b: Float64\noutput h @(a || b) := a.hold().defaults(to: 0)\noutput x @(a || b) := h[-2].defaults(to: -1)",
    "offset_realtime": "input a: Int64\ninput b: Float64\noutput h @1s := a.hold(or: 0)\noutput x @2s := h - h.offset(by: -3s).defaults(to: 0)",
}


@pytest.mark.parametrize("name", list(TASKS))
def test_tasks_hold_a_chunk(spark, name):
    rows = [(k, t, i, a and abs(a), b) for k, t, i, a, b in events(random.Random(14), 250)]
    trace = spark.createDataFrame(rows, KINDS).repartition(3)
    one, many = (evaluate(TASKS[name], trace, chunk_rows=c).line for c in (10**6, 20))
    assert most_rows_of_a_task(many) <= 3 * 20
    assert len({str(sorted(map(str, x.df.select("__ts", "__kind", "__seq", "x").collect()))) for x in (one, many)}) == 1


#: The first steps of these queries: what they hold, chunks leave to those after them.
HELD = {
    "offset_realtime": "input a: Int64\ninput b: Float64\noutput x @1s := a.hold(or: 0)",
    "offset_of_output": "input a: Int64\ninput b: Float64\noutput x @(a || b) := a.hold().defaults(to: 0)",
    "latch": "input a: Int64\ninput b: Float64\noutput x @(a || b) := if a.get().defaults(to: 0) > 5 then a.get().defaults(to: 0) else x[-1].defaults(to: -1)",
}


@pytest.mark.parametrize("name", list(HELD))
def test_what_chunks_leave_is_found_by_chunks(spark, name):
    """No aggregate sorts the rows of whole splits of the timeline."""
    trace = spark.createDataFrame(events(random.Random(15), 250), KINDS).repartition(3)
    one, many = (evaluate(HELD[name], trace, chunk_rows=c).line for c in (10**6, 20))
    assert many.chunks > 8 and "SortAggregate" not in many.df._jdf.queryExecution().executedPlan().toString()
    assert len({str(sorted(map(str, x.df.select("__ts", "__kind", "__seq", "x").collect()))) for x in (one, many)}) == 1


def clumps(name):
    """Times of 600 events: slots with under one and under two chunks of rows, one slot with clumps of several
    sizes, or instants with nearly two chunks of rows."""
    if name == "slots":  # at 100 rows a chunk a slot is 100 long
        return sorted([*range(10, 99)] + [100 + i // 2 for i in range(190)] + [1010 + i for i in range(60)] + [1200 + i // 2 for i in range(195)] + [1700 + i for i in range(65)] + [2399])
    if name == "sizes":
        return sorted([i // 8 for i in range(240)] + [1000 + i // 4 for i in range(245)] + [2000 + i for i in range(80)] + [2100 + i for i in range(34)] + [2399])
    return sorted([0] * 10 + [1000] * 180 + [1001] * 20 + [1002] * 190 + [1003] * 9 + [1800] * 190 + [2399])


@pytest.mark.parametrize("name", ["slots", "sizes", "instants"])
def test_no_chunk_holds_more_than_its_bound(spark, name):
    """However times are spread, a task has few more rows than a chunk should, and values are the same."""
    r = random.Random(16)
    rows = [("k", t, i, r.choice([None, r.randint(-9, 9)]), r.choice([None, i / 8])) for i, t in enumerate(clumps(name))]
    trace = spark.createDataFrame(rows, KINDS).repartition(3)
    one, many = (evaluate(TASKS["offset_of_output"], trace, chunk_rows=c).line for c in (10**6, 100))
    sizes = [x["count"] for x in many.df.groupBy(CHUNK).count().collect()]
    assert max(sizes) <= 175 and many.chunks <= 4 * 6
    assert most_rows_of_a_task(many) == max(sizes)
    assert len({str(sorted(map(str, x.df.select("__ts", "__kind", "__seq", "x").collect()))) for x in (one, many)}) == 1


def test_queries_declare_the_inputs_that_they_name():
    from streamspec import queries

    assert queries._named("output x @ (p || c) := u.hold()", "x") == "input u: Int64, p: Float64, c: Int64\n"
    assert queries._named("output x := 1", "x") == queries.INPUTS
