"""The engine against the cases, and the batch evaluator against the engine on random traces."""

import pickle
import random

import pytest

from streamspec.analysis.checker import check
from streamspec.plans.batch import evaluate
from streamspec.streaming.engine import Engine
from streamspec.streaming.monitor import Monitor
from tests.cases import CASES


def events(spec, data):
    head, *rows = [line.split(",") for line in data.strip().split("\n")]
    time = next(i for i, h in enumerate(head) if h == "time")
    kinds = {"Bool": lambda x: x == "true", "String": lambda x: x.strip('"'), "Bytes": str.encode, "Int": int, "UInt": int, "Float": float}
    out = []
    for row in rows:
        whole, _, frac = row[time].partition(".")
        ts = int(whole) * 10**9 + int(frac.ljust(9, "0")) if frac else int(whole)
        out.append((ts, {n: kinds[s.type.kind](row[head.index(n)]) for n, s in spec.inputs.items() if row[head.index(n)] != "#"}))
    return [(ts - out[0][0], v) for ts, v in out], out[0][0]


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    source, data, wanted = CASES[name]
    monitor = Monitor(source)
    rows, start = events(monitor.spec, data)
    found: dict[str, list[float]] = {}
    updates = [monitor.accept_event(v, ts) for ts, v in rows]
    updates.append(monitor.accept_time(rows[-1][0], including=True))
    for u in updates:
        for ts, _, m in u.triggers:
            found.setdefault(m, []).append((start + ts) / 10**6)
    assert {m: len(x) for m, x in found.items()} == {m: n if isinstance(n, int) else len(n) for m, n in wanted.items()}
    assert all(found[m] == n for m, n in wanted.items() if not isinstance(n, int))


def test_updates_hold_what_changed():
    m = Monitor("input a: Int64\noutput b := a + 1\noutput c @1Hz := a.hold().defaults(to: 0)")
    assert m.accept_event({"a": 1}, 0).event == {"b": 2}
    u = m.accept_event({"a": 5}, 2_000_000_000)
    assert u.timed == [(0, {"c": 1}), (1_000_000_000, {"c": 1})] and u.event == {"b": 6}
    assert m.accept_time(2_500_000_000).timed == [(2_000_000_000, {"c": 5})]
    with pytest.raises(ValueError):
        m.accept_event({"a": 1}, 1)


SPEC = """
import math
input a: Int64, b: Float64, c: Bool
output s := a + a.offset(by: -1).defaults(to: 0)
output h @ (a || c) := b.hold(or: 0.5)
output g @ a := c.get()
output t5 @ c := t5[-1].defaults(to: 0) + 1
output latch := if c then 1 else latch[-1].defaults(to: 7)
output fold := (fold[-1].defaults(to: 3) * 5 + a) % 1009
output other @ a := other[-2].defaults(to: 1) + fold
output far := b[-6]
output w1 @ 500ms := a.aggregate(over: 2s, using: sum)
output w2 @ 1s := b.aggregate(over: 1500ms, using: avg)
output w3 @ 1s := c.aggregate(over: 3s, using: exists)
output w4 @ 1s := b.aggregate(over_exactly: 2s, using: integral)
output w5 @ 1s := a.aggregate(over: 700ms, using: max).defaults(to: -1)
output w6 @ 2s := w1.aggregate(over: 5s, using: count)
output p @ 1s := s.hold(or: 0) + w1
output q := p.hold(or: -1) + a
output m := min(b, abs(b[-1].defaults(to: 2.0)))
output big @ b := b.offset(by: -2).defaults(to: 0.0) > 1.0 || b < -1.0
trigger s > 5 && fold % 2 = 0
"""


@pytest.mark.parametrize("seed,chunk_rows", [(1, 10**6), (2, 10**6), (3, 25), (4, 60)])
def test_batch_against_engine(spark, seed, chunk_rows):
    r, spec = random.Random(seed), check(SPEC)
    ts, rows = 0, []
    for i in range(120):
        ts += r.choice([0, 1, 10**6, 10**8, 250_000_000, 5 * 10**8, 123_456_789]) if i else 0
        rows.append((ts, i, r.choice([None, r.randint(-9, 9)]), r.choice([None, r.randint(-40, 40) / 8]), r.choice([None, True, False])))
    trace = spark.createDataFrame(rows, "__ts bigint, __seq bigint, a bigint, b double, c boolean").repartition(3)
    res = evaluate(spec, trace, chunk_rows=chunk_rows)
    assert (res.line.chunks > 1) == (chunk_rows < 1000)
    names = list(spec.outputs)
    got = {}
    for row in res.line.df.select("__ts", "__kind", "__seq", *names).collect():
        got[row["__ts"], row["__kind"], row["__seq"]] = {n: row[n].v for n in names if row[n] is not None}
    engine, want = Engine(spec), {}
    for ts, seq, a, b, c in rows:
        for at, v in engine.deadlines(ts):
            want[at, 1, 0] = v
        want[ts, 0, seq] = engine.event(ts, {"a": a, "b": b, "c": c})
    for at, v in engine.deadlines(rows[-1][0], including=True):
        want[at, 1, 0] = v
    assert set(got) == set(want)
    for key, values in want.items():
        own = {n: v for n, v in values.items() if n in names}
        assert set(got[key]) == set(own), key
        for n, v in own.items():
            assert got[key][n] == v or got[key][n] == pytest.approx(v, abs=1e-9), (key, n, got[key][n], v)


def test_state_can_be_pickled():
    spec = check(SPEC)
    one, two = Engine(spec), Engine(spec)
    r, ts = random.Random(9), 0
    for _ in range(60):
        ts += r.randint(0, 10**9)
        v = {"a": r.randint(0, 9), "b": r.random(), "c": None}
        assert list(one.deadlines(ts)) == list(two.deadlines(ts)) and one.event(ts, v) == two.event(ts, v)
        two = pickle.loads(pickle.dumps(two))
