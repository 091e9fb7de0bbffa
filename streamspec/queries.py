"""Queries over the events table, one for each operator, and SQL with the same rows.

The trace has v (value), u (user), q (event number), s (event type), and inputs that only some events
have: p (value of purchases) and pc (the same in cents, whole numbers, so that sums are exact in any
order), c (user of clicks), e (errors true, views false). Times are nanoseconds since the first event.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamspec.analysis.checker import check
from streamspec.plans.batch import Result, evaluate
from streamspec.sinks import text
from streamspec.sources import csv, pcap
from streamspec.sources.infer import infer
from streamspec.sources.trace import Trace, delayed
from streamspec.storage import scratch

INPUTS = "input v: Float64, u: Int64, q: UInt64, s: String, p: Float64, pc: Float64, c: Int64, e: Bool\n"
TRACE_SQL = """t AS (
  SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 1000 AS ts, event_id AS q, value AS v, user_id AS u, event_type AS s,
         CASE WHEN event_type = 'purchase' THEN value END AS p, CASE WHEN event_type = 'purchase' THEN round(value * 100) END AS pc, CASE WHEN event_type = 'click' THEN user_id END AS c,
         CASE event_type WHEN 'error' THEN true WHEN 'view' THEN false END AS e
  FROM events
)"""
HOUR, MINUTE = 3600 * 10**9, 60 * 10**9


def trace(spark: SparkSession, sf_dir: str) -> Trace:
    """The events as a trace. Times are unique, so the event number only has to be an order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp")))).first()[0] or 0
    kind = F.col("event_type")
    df = events.select(
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(start)) * 1000).alias("__ts"),
        F.col("event_id").alias("__seq"),
        F.col("value").alias("v"), F.col("user_id").alias("u"), F.col("event_id").alias("q"), kind.alias("s"),
        F.when(kind == "purchase", F.col("value")).alias("p"),
        F.when(kind == "purchase", F.round(F.col("value") * 100)).alias("pc"),
        F.when(kind == "click", F.col("user_id")).alias("c"),
        F.when(kind == "error", F.lit(True)).when(kind == "view", F.lit(False)).alias("e"),
    )
    return Trace(df, start * 1000)


def run(spark: SparkSession, sf_dir: str, spec: str, keys: tuple[str, ...] = ()) -> Result:
    return evaluate(INPUTS + spec, trace(spark, sf_dir).df, keys)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _named(*texts: str) -> str:
    """The declarations of the inputs that texts name: others would only be carried through every step."""
    words = set(re.findall(r"\w+", " ".join(texts)))
    own = [x for x in INPUTS.strip().removeprefix("input ").split(", ") if x.split(":")[0] in words]
    return f"input {', '.join(own)}\n" if own else INPUTS


def _streams(spec: str, *names: str, rounded: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """A query for ts and values of streams with the clock of the first one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        res = evaluate(_named(spec, *names) + spec, trace(spark, sf_dir).df)
        rows = res.line.df.where(F.col(f"`{names[0]}`").isNotNull())
        made = rows.select(F.col("__ts").alias("ts"), *[F.col(f"`{n}`")["v"].alias(n) for n in names])
        return _rounded(made) if rounded else made

    return query


def _panes(period: int, duration: int) -> str:
    """SQL: deadlines d and the trace rows in their windows."""
    length = duration // 64

    def pane(x: str) -> str:
        sec = f"(({x}) // 1000000000)::DOUBLE + (({x}) % 1000000000)::DOUBLE / 1e9"
        unit = f"({length} // 1000000000)::DOUBLE + ({length} % 1000000000)::DOUBLE / 1e9"
        return f"floor(({sec}) / ({unit}))"

    return f"""d AS (SELECT i * {period} AS d FROM range(0, (SELECT max(ts) FROM t) // {period} + 1) r(i)),
w AS (SELECT d.d, t.* FROM d LEFT JOIN t ON t.ts <= d.d AND t.ts >= d.d - {duration} - {length} AND {pane("d.d")} - {pane("t.ts")} <= 63)"""


def _window(select: str, period: int, duration: int) -> str:
    return f"WITH {TRACE_SQL}, {_panes(period, duration)} SELECT d AS ts, {select} FROM w GROUP BY d"


def _lag_sql(expr: str, where: str) -> str:
    return f"WITH {TRACE_SQL} SELECT ts, {expr} FROM t WHERE {where}"


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def add(name: str, spec: str, streams: str, sql: str | None, rounded: bool = True) -> None:
    Q[name] = (_streams(spec, *streams.split(), rounded=rounded), sql)


def plain(sql: str) -> str:
    return f"WITH {TRACE_SQL} {sql}"


# projections, conditions, access at the same instant

add("sync_add", "output x := v + p\noutput y := u * 2 - 1", "x y", plain("SELECT ts, round(v + p, 4) AS x, u * 2 - 1 AS y FROM t WHERE p IS NOT NULL"))
add("conditional", "output x := if v > 50.0 then u else -u\noutput y: Bool := !(v > 50.0) && u >= 10 || s = \"click\"", "x y",
    plain("SELECT ts, CASE WHEN v > 50 THEN u ELSE -u END AS x, (NOT (v > 50) AND u >= 10 OR s = 'click') AS y FROM t"))
add("constants", "constant k: Float64 := 2.5\nconstant n: Int64 := -3\noutput x := v * k\noutput y := u + n", "x y", plain("SELECT ts, round(v * 2.5, 4) AS x, u - 3 AS y FROM t"))
add("activation_disjunction", "output x @ (p || c) := v.hold(or: 0.0)", "x", plain("SELECT ts, round(v, 4) AS x FROM t WHERE p IS NOT NULL OR c IS NOT NULL"))
add("activation_conjunction", "output x @ (p && v || e) := q.get().defaults(to: 0)", "x", plain("SELECT ts, q AS x FROM t WHERE (p IS NOT NULL AND v IS NOT NULL) OR e IS NOT NULL"))
add("get_default", "output x @ v := p.get().defaults(to: -1.0)\noutput y @ v := c.get()", "x y", plain("SELECT ts, round(coalesce(p, -1.0), 4) AS x, c AS y FROM t"))
add("tuples", "output x := (u, (v, s))\noutput y := x.0 + 1\noutput z := x.1.1", "y z", plain("SELECT ts, u + 1 AS y, s AS z FROM t"))

# the past

add("hold_event", "output x @ v := p.hold().defaults(to: -1.0)\noutput y @ v := e.hold()", "x y",
    plain("SELECT ts, round(coalesce(last_value(p IGNORE NULLS) OVER o, -1.0), 4) AS x, last_value(e IGNORE NULLS) OVER o AS y FROM t WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)"))
add("hold_periodic", "output x @ 1h := v.hold(or: 0.0)\noutput y @ 1h := c.hold()", "x y", f"""
WITH {TRACE_SQL}, d AS (SELECT i * {HOUR} AS d FROM range(0, (SELECT max(ts) FROM t) // {HOUR} + 1) r(i))
SELECT d.d AS ts, round(coalesce(t.v, 0.0), 4) AS x, k.c AS y
FROM d ASOF LEFT JOIN t ON d.d >= t.ts ASOF LEFT JOIN (SELECT ts, c FROM t WHERE c IS NOT NULL) k ON d.d >= k.ts""")
add("hold_of_periodic", "output a @ 6h := v.aggregate(over: 6h, using: count)\noutput x @ p := a.hold().defaults(to: 0)", "x", f"""
WITH {TRACE_SQL}, {_panes(6 * HOUR, 6 * HOUR)}, a AS (SELECT d, count(v) AS n FROM w GROUP BY d)
SELECT t.ts, coalesce(a.n, 0)::BIGINT AS x FROM t ASOF LEFT JOIN a ON t.ts > a.d WHERE t.p IS NOT NULL""")
add("offset_1", "output x := p - p.offset(by: -1).defaults(to: 0.0)", "x", _lag_sql("round(p - coalesce(lag(p) OVER (ORDER BY ts), 0), 4) AS x", "p IS NOT NULL"))
add("offset_3", "output x := c[-3].defaults(to: 0)", "x", _lag_sql("coalesce(lag(c, 3) OVER (ORDER BY ts), 0) AS x", "c IS NOT NULL"))
add("offset_20", "output x := p[-20]", "x", _lag_sql("round(lag(p, 20) OVER (ORDER BY ts), 4) AS x", "p IS NOT NULL"))
add("offset_of_output", "output a @ (p || c) := u.hold().defaults(to: 0)\noutput x @ (p || c) := a[-2].defaults(to: -1)", "x",
    _lag_sql("coalesce(lag(u, 2) OVER (ORDER BY ts), -1) AS x", "p IS NOT NULL OR c IS NOT NULL"))
add("offset_realtime", "output a @ 10min := v.hold(or: 0.0)\noutput x @ 1h := a - a.offset(by: -30min).defaults(to: 0.0)", "x", f"""
WITH {TRACE_SQL}, d AS (SELECT i * {10 * MINUTE} AS d FROM range(0, (SELECT max(ts) FROM t) // {10 * MINUTE} + 1) r(i)),
a AS (SELECT d.d, coalesce(t.v, 0.0) AS a FROM d ASOF LEFT JOIN t ON d.d >= t.ts)
SELECT d AS ts, round(a - coalesce(b, 0.0), 4) AS x FROM (SELECT d, a, lag(a, 3) OVER (ORDER BY d) AS b FROM a) WHERE d % {HOUR} = 0""")
add("periodic_gcd", "output a @ 2h := u.hold().defaults(to: 0)\noutput b @ 3h := u.hold().defaults(to: 1)\noutput x := a + b", "x", f"""
WITH {TRACE_SQL}, d AS (SELECT i * {6 * HOUR} AS d FROM range(0, (SELECT max(ts) FROM t) // {6 * HOUR} + 1) r(i))
SELECT d.d AS ts, coalesce(t.u, 0) + coalesce(t.u, 1) AS x FROM d ASOF LEFT JOIN t ON d.d >= t.ts""")

add("frequencies", "output a @ 1mHz := u.hold().defaults(to: 0)\noutput b @ 0.5mHz := a + 1\noutput x @ 250uHz := a + b", "x", f"""
WITH {TRACE_SQL}, d AS (SELECT i * {4000 * 10**9} AS d FROM range(0, (SELECT max(ts) FROM t) // {4000 * 10**9} + 1) r(i))
SELECT d.d AS ts, 2 * coalesce(t.u, 0) + 1 AS x FROM d ASOF LEFT JOIN t ON d.d >= t.ts""")

# sliding windows

add("tumbling", "output n @ 6h := p.aggregate(over: 6h, using: count)\noutput m @ 6h := v.aggregate(over: 6h, using: max).defaults(to: 0.0)", "n m", _window("count(p)::BIGINT AS n, round(coalesce(max(v), 0), 4) AS m", 6 * HOUR, 6 * HOUR))
add("window_often", "output x @ 1min := p.aggregate(over: 2h, using: sum)", "x", _window("round(coalesce(sum(p), 0), 4) AS x", MINUTE, 2 * HOUR))
for _name, _f, _target, _sql in (
    ("count", "count", "p", "count(p)::BIGINT AS x"),
    ("sum", "sum", "v", "round(coalesce(sum(v), 0), 4) AS x"),
    ("sum_int", "sum", "c", "coalesce(sum(c), 0)::BIGINT AS x"),
    ("sum_bool", "sum", "e", "coalesce(sum(e::INT), 0)::BIGINT AS x"),
    ("avg", "avg", "pc", "sum(pc) / count(pc) AS x"),
    ("avg_int", "avg", "c", "(CASE WHEN count(c) > 0 THEN sum(c) // count(c) END)::BIGINT AS x"),
    ("min", "min", "v", "round(min(v), 4) AS x"),
    ("max", "max", "c", "max(c) AS x"),
    ("forall", "forall", "e", "coalesce(bool_and(e), true) AS x"),
    ("exists", "exists", "e", "coalesce(bool_or(e), false) AS x"),
):
    add(f"window_{_name}", f"output x @ 10min := {_target}.aggregate(over: 1h, using: {_f})", "x", _window(_sql, 10 * MINUTE, HOUR), rounded=_name != "avg")
add("window_exactly", "output x @ 30min := p.aggregate(over_exactly: 6h, using: count)", "x",
    f"WITH {TRACE_SQL}, {_panes(30 * MINUTE, 6 * HOUR)} SELECT d AS ts, CASE WHEN d >= {6 * HOUR} THEN count(p) END::BIGINT AS x FROM w GROUP BY d")
add("window_wide", "output x @ 10min := v.aggregate(over: 1d, using: max).defaults(to: 0.0)", "x", _window("round(coalesce(max(v), 0), 4) AS x", 10 * MINUTE, 24 * HOUR))
add("window_integral", "output x @ 1h := p.aggregate(over: 6h, using: integral)", "x", f"""
WITH {TRACE_SQL}, {_panes(HOUR, 6 * HOUR)},
i AS (SELECT d, p, ts, lag(p) OVER o AS p0, lag(ts) OVER o AS t0 FROM w WHERE p IS NOT NULL WINDOW o AS (PARTITION BY d ORDER BY ts))
SELECT d.d AS ts, round(coalesce(s, 0.0), 4) AS x FROM d LEFT JOIN (SELECT d, sum(coalesce((p + p0) / 2 * ((ts - t0)::DOUBLE / 1e9), 0)) AS s FROM i GROUP BY d) USING (d)""")
add("window_of_output", "output a := v * 2.0\noutput n @ 10min := a.aggregate(over: 30min, using: count)\noutput x @ 1h := n.aggregate(over: 3h, using: sum)", "x", f"""
WITH {TRACE_SQL}, {_panes(10 * MINUTE, 30 * MINUTE)}, n AS (SELECT d, count(v) AS n FROM w GROUP BY d),
h AS (SELECT i * {HOUR} AS h FROM range(0, (SELECT max(ts) FROM t) // {HOUR} + 1) r(i))
SELECT h.h AS ts, sum(n.n)::BIGINT AS x FROM h JOIN n ON n.d <= h.h AND floor((h.h / 1e9) / 168.75) - floor((n.d / 1e9) / 168.75) <= 63 GROUP BY h.h""")

# recursion

_RUN = "WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)"
add("running_sum", "output x := x[-1].defaults(to: 10) + c", "x", plain(f"SELECT ts, 10 + (sum(c) OVER o)::BIGINT AS x FROM t WHERE c IS NOT NULL {_RUN}"))
add("running_count", "output x @ p := x[-1].defaults(to: 0) + 1", "x", plain(f"SELECT ts, count(*) OVER o AS x FROM t WHERE p IS NOT NULL {_RUN}"))
add("running_min", "import math\noutput x := min(x[-1].defaults(to: 100.0), p)", "x", plain(f"SELECT ts, round(least(100.0, min(p) OVER o), 4) AS x FROM t WHERE p IS NOT NULL {_RUN}"))
add("running_max", "import math\noutput x := max(p, x[-1].defaults(to: 0.0))", "x", plain(f"SELECT ts, round(greatest(0.0, max(p) OVER o), 4) AS x FROM t WHERE p IS NOT NULL {_RUN}"))
add("running_or", "output x := x[-1].defaults(to: false) || v > 200.0", "x", plain(f"SELECT ts, bool_or(v > 200) OVER o AS x FROM t {_RUN}"))
add("running_and", "output x := x[-1].defaults(to: true) && v < 200.0", "x", plain(f"SELECT ts, bool_and(v < 200) OVER o AS x FROM t {_RUN}"))
add("latch", "output x := if v > 100.0 then u else x[-1].defaults(to: -1)", "x",
    plain(f"SELECT ts, coalesce(last_value(CASE WHEN v > 100 THEN u END IGNORE NULLS) OVER o, -1) AS x FROM t {_RUN}"))
add("toggle", "output x @ p := !x[-1].defaults(to: false)", "x", plain(f"SELECT ts, (count(*) OVER o) % 2 = 1 AS x FROM t WHERE p IS NOT NULL {_RUN}"))
add("recursion", "output x := (x[-1].defaults(to: 1) * 31 + c) % 1000003", "x", f"""
WITH RECURSIVE {TRACE_SQL}, n AS (SELECT ts, c, row_number() OVER (ORDER BY ts) AS i FROM t WHERE c IS NOT NULL),
r AS (SELECT i, ts, (31 + c) % 1000003 AS x FROM n WHERE i = 1 UNION ALL SELECT n.i, n.ts, (r.x * 31 + n.c) % 1000003 FROM r JOIN n ON n.i = r.i + 1)
SELECT ts, x FROM r""")
add("mutual_recursion", "output a := b[-1].defaults(to: 0) + c\noutput b @ c := a[-2].defaults(to: 1) % 97", "a b", f"""
WITH RECURSIVE {TRACE_SQL}, n AS (SELECT ts, c, row_number() OVER (ORDER BY ts) AS i FROM t WHERE c IS NOT NULL),
r AS (SELECT i, ts, c AS a, 1::BIGINT AS b, NULL::BIGINT AS a1 FROM n WHERE i = 1
      UNION ALL SELECT n.i, n.ts, r.b + n.c, coalesce(r.a1, 1) % 97, r.a FROM r JOIN n ON n.i = r.i + 1)
SELECT ts, a, CASE WHEN i <= 2 THEN 1 ELSE b END AS b FROM r""")

# scalars

add("arithmetic", "output x := (u - 7) / 3 * 2 + u % 4 - -u\noutput y := v / 4.0 - v * 0.5 + v % 3.0\noutput z := u ** 2 + 2 ** 10\noutput w := v ** 2.0", "x y z w",
    plain("SELECT ts, (u - 7) // 3 * 2 + u % 4 + u AS x, round(v / 4 - v * 0.5 + v % 3, 4) AS y, u * u + 1024 AS z, round(v * v, 4) AS w FROM t"))
add("bits", "output x := u & 12 | u ^ 5\noutput y := u << 3\noutput z := u >> 2\noutput w := ~u", "x y z w",
    plain("SELECT ts, (u & 12) | xor(u, 5) AS x, u << 3 AS y, u >> 2 AS z, -u - 1 AS w FROM t"))
add("comparisons", "output a := u = 10\noutput b := u != 10\noutput c2 := v < 10.0\noutput d := v <= 10.0\noutput f := s > \"error\"\noutput g := u >= 75", "a b c2 d f g",
    plain("SELECT ts, u = 10 AS a, u <> 10 AS b, v < 10 AS c2, v <= 10 AS d, s > 'error' AS f, u >= 75 AS g FROM t"))
add("math_functions", "import math\noutput a := sqrt(v)\noutput b := sin(v) + cos(v)\noutput d := arctan(v)\noutput f := abs(u - 50)\noutput g := min(v, 20.0)\noutput h := max(u, 70)\noutput i := v.sqrt()", "a b d f g h i",
    plain("SELECT ts, round(sqrt(v), 4) AS a, round(sin(v) + cos(v), 4) AS b, round(atan(v), 4) AS d, abs(u - 50) AS f, round(least(v, 20.0), 4) AS g, greatest(u, 70) AS h, round(sqrt(v), 4) AS i FROM t"))
add("casts", "output a: Float64 := cast(u)\noutput b: Int64 := cast(v)\noutput d: UInt64 := cast<Float64, UInt64>(v - 50.0)", "a b d",
    plain("SELECT ts, u::DOUBLE AS a, trunc(v)::BIGINT AS b, greatest(0, trunc(v - 50))::BIGINT AS d FROM t"))
add("literals", "output a @v := 31 + 7\noutput b @v := 2.5\noutput d @v := \"a'b\"\noutput f @v := !false\noutput g @v := -(+3)", "a b d f g", plain("SELECT ts, 38::BIGINT AS a, 2.5::DOUBLE AS b, 'a''b' AS d, true AS f, -3::BIGINT AS g FROM t"))
add("regex", 'import regex\noutput x := matches(s, regex: "^(c|p).*[ek]$")\noutput y := s.matches(regex: "r{2}")', "x y",
    plain("SELECT ts, regexp_matches(s, '^(c|p).*[ek]$') AS x, regexp_matches(s, 'r{2}') AS y FROM t"))


# sinks, statistics, keys

TRIGGERS = 'trigger v > 300.0 "high"\ntrigger p > 100.0 && u < 10\ntrigger e\n'


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, TRIGGERS).triggers().select("ts", "trigger", "message")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, TRIGGERS + "trigger q > 1000000000 \"never\"").statistics()


def output_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "output a := c + 1\noutput b @ 6h := u.hold().defaults(to: 0)").log().select("ts", "stream", "value")


def bytes_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trace(spark, sf_dir).df.withColumn("raw", F.col("s").cast("binary"))
    spec = 'import regex\ninput raw: Bytes\noutput x := raw.at(index: 0).defaults(to: 0)\noutput y := raw.at(index: 5)\noutput z := raw.matches(regex: "^p.r")'
    return evaluate(spec, df).values("x", "y", "z").select("ts", "x", "y", "z")


def csv_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through CSV files: times as seconds with decimals, values as text, # for none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros, kind = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_type")
    second = F.concat(F.call_function("div", micros, F.lit(10**6)).cast("string"), F.lit("."), F.lpad((micros % 10**6).cast("string"), 6, "0"))
    cells = events.select(
        F.coalesce(F.when(kind != "view", F.col("user_id").cast("string")), F.lit("#")).alias("user"), second.alias("time"),
        F.col("value").cast("string").alias("unused"), F.coalesce(F.when(kind == "error", F.lit("true")), F.lit("#")).alias("bad"), kind.alias("kind"),
    )
    path = scratch(spark, "csv")
    cells.write.option("header", True).csv(path)
    spec = check("input user: UInt64, bad: Bool, kind: String\noutput n @bad := user.hold().defaults(to: 0)\noutput k @user := kind.get().defaults(to: \"\")")
    read = csv.read(spark, path, spec, check_order=False)
    res = evaluate(spec, read.df)
    return res.line.df.where("n IS NOT NULL OR k IS NOT NULL").select(F.col("__ts").alias("ts"), F.lit(read.start).alias("start"), F.col("n")["v"].alias("n"), F.col("k")["v"].alias("k"))


def packets(spark: SparkSession, sf_dir: str) -> str:
    """Events as UDP packets in capture files, one of each partition, written under names of their own so
    that a task that runs again writes the same; the folder."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", "user_id", "event_type")
    folder = scratch(spark, "pcap")

    def framed(rows):
        for r in rows:
            payload = r["event_type"].encode()
            udp = struct.pack("!HHHH", 1024 + r["event_id"] % 50_000, 53, 8 + len(payload), 0) + payload
            target = (192, 168, 1, 1) if r["event_type"] in ("click", "view") else (8, 8, 8, 8)
            source = (10, *(r["user_id"] >> k & 255 for k in (16, 8, 0)))
            ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, bytes(source), bytes(target))
            frame = bytes(range(12)) + struct.pack("!H", 0x0800) + ip + udp
            yield struct.pack("<IIII", r["micros"] // 10**6, r["micros"] % 10**6, len(frame), len(frame)) + frame

    def write(batches):
        part, packets = TaskContext.get().partitionId(), 0
        system, path = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{part:05d}.pcap") as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65_535, 1))
            for batch in batches:
                f.write(b"".join(framed(batch.to_pylist())))
                packets += batch.num_rows
        yield pa.RecordBatch.from_pydict({"packets": [packets]})

    cells.mapInArrow(write, "packets long").agg(F.sum("packets")).collect()
    return folder


def pcap_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through packet captures: Ethernet, IPv4 and UDP fields, payload and direction."""
    octets = "(UInt64, UInt64, UInt64, UInt64)"
    spec = check(f"""input IPv4::source: {octets}, IPv4::ttl: UInt64, UDP::source: UInt64, UDP::length: UInt64, payload: String, direction: String, TCP::source: UInt64
output host := IPv4::source.2 * 256 + IPv4::source.3
output port := UDP::source + IPv4::ttl - 64
output size := UDP::length - 8
output what := if direction = "Incoming" then payload else "out"
output tcp @payload := TCP::source.get().defaults(to: 0)""")
    res = evaluate(spec, pcap.read(spark, packets(spark, sf_dir), spec, "192.168.0.0/16").df)
    return res.values("host", "port", "size", "what", "tcp").select("ts", "host", "port", "size", "what", "tcp")


def delayed_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without times: one each 250 ms, in the order of their numbers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("u"))
    res = evaluate("input u: Int64\noutput x := u - u[-1].defaults(to: 0)", delayed(events, "250ms", [F.col("event_id")]).df)
    return res.values("x").select("ts", "x")


def trigger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trace(spark, sf_dir)
    return text.lines(evaluate(INPUTS + TRIGGERS, made.df), made.start, "absolute")


def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(run(spark, sf_dir, "output a := c + 1\noutput b @ 6h := u.hold().defaults(to: 0)\ntrigger a > 90"), 0, "relative", "outputs")


def keyed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent traces by user: a parameterised stream as partitions."""
    df = trace(spark, sf_dir).df.withColumn("user", F.col("u"))
    res = evaluate(INPUTS + "output n @ v := n[-1].defaults(to: 0) + 1\noutput d := v - v[-1].defaults(to: v)", df, ("user",))
    return _rounded(res.values("n", "d").select("user", "ts", "n", "d"))


def keyed_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trace(spark, sf_dir).df.withColumn("user", F.col("u"))
    res = evaluate(INPUTS + "output x := (x[-1].defaults(to: 1) * 31 + q) % 1009", df, ("user",))
    return res.values("x").select("user", "ts", "x")


def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "user_id", "event_type", "value")
    cells = cells.select(*[F.col(c).cast("string").alias(c) for c in cells.columns])
    return infer(cells, order=F.col("event_id").cast("bigint"))


Q["triggers"] = (triggers, plain("""
SELECT ts, 0 AS trigger, 'high' AS message FROM t WHERE v > 300 UNION ALL
SELECT ts, 1, 'p > 100.0 ∧ u < 10' FROM t WHERE p > 100 AND u < 10 UNION ALL
SELECT ts, 2, 'e' FROM t WHERE e"""))
Q["statistics"] = (statistics, plain("""
SELECT i AS trigger, m AS message, n AS fired, (SELECT count(*) FROM t) AS cycles FROM (
SELECT 0 AS i, 'high' AS m, count(*) AS n FROM t WHERE v > 300 UNION ALL
SELECT 1, 'p > 100.0 ∧ u < 10', count(*) FROM t WHERE p > 100 AND u < 10 UNION ALL
SELECT 2, 'e', count(*) FROM t WHERE e UNION ALL SELECT 3, 'never', 0)"""))
Q["output_log"] = (output_log, f"""
WITH {TRACE_SQL}, d AS (SELECT i * {6 * HOUR} AS d FROM range(0, (SELECT max(ts) FROM t) // {6 * HOUR} + 1) r(i))
SELECT ts, 'a' AS stream, (c + 1)::VARCHAR AS value FROM t WHERE c IS NOT NULL UNION ALL
SELECT d.d, 'b', coalesce(t.u, 0)::VARCHAR FROM d ASOF LEFT JOIN t ON d.d >= t.ts""")
Q["bytes_functions"] = (bytes_functions, plain("SELECT ts, ascii(s)::SMALLINT AS x, (CASE WHEN length(s) > 5 THEN ascii(substr(s, 6, 1)) END)::SMALLINT AS y, regexp_matches(s, '^p.r') AS z FROM t"))
Q["csv_trace"] = (csv_trace, f"""
WITH {TRACE_SQL}, h AS (
  SELECT ts, s, u, (SELECT min(epoch_us(ts)) FROM events) * 1000 AS start, last_value(CASE WHEN s <> 'view' THEN u END IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS last FROM t)
SELECT ts, start, CASE WHEN s = 'error' THEN coalesce(last, 0) END AS n, CASE WHEN s <> 'view' THEN s END AS k FROM h WHERE s <> 'view'""")
Q["pcap_trace"] = (pcap_trace, plain("""
SELECT ts, u % 65536 AS host, 1024 + q % 50000 AS port, length(s)::BIGINT AS size, CASE WHEN s IN ('click', 'view') THEN s ELSE 'out' END AS what, 0::BIGINT AS tcp FROM t"""))
Q["delayed_clock"] = (delayed_clock, """
SELECT i * 250000000 AS ts, u - coalesce(lag(u) OVER (ORDER BY i), 0) AS x FROM (SELECT user_id AS u, row_number() OVER (ORDER BY event_id) AS i FROM events)""")
Q["trigger_lines"] = (trigger_lines, plain("""
SELECT printf('%d.%09d: Trigger: %s', wall // 1000000000, wall % 1000000000, m) AS line FROM (
SELECT ts + (SELECT min(epoch_us(ts)) FROM events) * 1000 AS wall, m FROM (SELECT ts, 'high' AS m FROM t WHERE v > 300 UNION ALL
SELECT ts, 'p > 100.0 ∧ u < 10' FROM t WHERE p > 100 AND u < 10 UNION ALL SELECT ts, 'e' FROM t WHERE e))"""))
Q["output_lines"] = (output_lines, f"""
WITH {TRACE_SQL}, d AS (SELECT i * {6 * HOUR} AS d FROM range(0, (SELECT max(ts) FROM t) // {6 * HOUR} + 1) r(i)),
l AS (SELECT ts, 'OutputStream[0] := ' || (c + 1) || '.' AS m FROM t WHERE c IS NOT NULL UNION ALL SELECT d.d, 'OutputStream[1] := ' || coalesce(t.u, 0) || '.' FROM d ASOF LEFT JOIN t ON d.d >= t.ts
UNION ALL SELECT ts, 'Trigger: a > 90' FROM t WHERE c + 1 > 90)
SELECT printf('%d.%09d: %s', ts // 1000000000, ts % 1000000000, m) AS line FROM l""")
Q["keyed_runs"] = (keyed_runs, plain(
    "SELECT u AS user, ts, row_number() OVER o AS n, round(v - coalesce(lag(v) OVER o, v), 4) AS d FROM t WINDOW o AS (PARTITION BY u ORDER BY ts)"))
Q["keyed_recursion"] = (keyed_recursion, f"""
WITH RECURSIVE {TRACE_SQL}, n AS (SELECT ts, u, q, row_number() OVER (PARTITION BY u ORDER BY ts) AS i FROM t),
r AS (SELECT i, u, ts, (31 + q) % 1009 AS x FROM n WHERE i = 1 UNION ALL SELECT n.i, n.u, n.ts, (r.x * 31 + n.q) % 1009 FROM r JOIN n ON n.u = r.u AND n.i = r.i + 1)
SELECT u AS user, ts, x FROM r""")
Q["infer_schema"] = (infer_schema, """
SELECT * FROM (VALUES ('event_id', ['Int64', 'UInt64', 'Float64', 'String'], true), ('micros', ['Int64', 'UInt64', 'Float64', 'String'], true),
('user_id', ['Int64', 'UInt64', 'Float64', 'String'], false), ('event_type', ['String'], false), ('value', ['Float64', 'String'], false)) x("column", "types", clock)""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in the last hour, every ten minutes, and the alarms that they raise."""
    spec = 'output errors @ 10min := e.aggregate(over: 1h, using: sum)\ntrigger errors > 2 "many errors"\n'
    return run(spark, sf_dir, spec).triggers().select("ts", "trigger", "message")


Q["flagship"] = (flagship, f"WITH {TRACE_SQL}, {_panes(10 * MINUTE, HOUR)} SELECT d AS ts, 0 AS trigger, 'many errors' AS message FROM w GROUP BY d HAVING sum(e::INT) > 2")

QUERIES = {name: q for name, (q, _) in Q.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in Q.items() if sql}
