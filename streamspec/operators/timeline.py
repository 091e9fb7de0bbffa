"""The timeline: all instants at which streams can have values, in order.

Events and deadlines are rows of one table with ``ts`` (nanoseconds since the first event), ``kind``
(0 for events, 1 for deadlines) and ``seq`` (order of events at the same time). Events come before
deadlines at the same time.

A window over the whole timeline would be one task. So a long timeline is cut into chunks with about
equally many rows: windows run in each chunk, and what a chunk needs from those before it is computed
from one row for each chunk and joined back. Each chunk is a task of its own, however long the timeline is. Chunks are cut between times, and within an instant by the order of its
events where one instant has more rows than a chunk. With keys, each key has its own rows of a chunk,
so a frequent key is as many tasks as it has chunks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamspec.storage import materialise

#: Rows in a chunk: what one task sorts, at most some hundred MB. Timelines up to this are one chunk.
CHUNK_ROWS = 1_000_000
#: Shares of rows at most, which bounds the table of one row a chunk that is broadcast (chunks then hold
#: more rows; where times come in clumps, there are a few chunks a share), and slots of time for each.
MOST_CHUNKS, SLOTS = 32_768, 4
#: Shares that a chunk of whole slots may hold, those of a part of a slot, and those of one instant beyond
#: which it is cut. No chunk holds more than the last two together.
MOST, PART, INSTANT = 1.5, 1.25, 0.5
ORDER = ("__ts", "__kind", "__seq")
CHUNK = "__chunk"


@dataclass
class Timeline:
    """A table of instants with the columns of streams, and how it is cut.

    keys: columns that divide the trace into independent ones, each with its own order.
    """

    df: DataFrame
    last: int
    chunks: int = 1
    keys: tuple[str, ...] = ()

    def with_df(self, df: DataFrame) -> Timeline:
        return replace(self, df=df)

    @property
    def parts(self) -> list[str]:
        return [*self.keys, *([CHUNK] if self.chunks > 1 else [])]

    def window(self, *more: Column) -> Window:
        """Rows of a part in order."""
        by = [*map(F.col, self.parts), *more]
        return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*ORDER)

    def dealt(self) -> DataFrame:
        """The rows with each part in one task: a task a chunk, or with keys a number of tasks that follows
        the rows. The number is fixed, since small partitions would else be put together to tasks that grow."""
        if self.chunks == 1:
            return self.df
        if not self.keys:
            return self.df.repartitionById(self.chunks, F.col(CHUNK))
        return self.df.repartition(self.tasks, *map(F.col, self.parts))

    @property
    def tasks(self) -> int:
        """Tasks among which rows are dealt by a hash."""
        return max(2 * self.chunks, self.df.sparkSession.sparkContext.defaultParallelism)

    def settled(self) -> Timeline:
        """The timeline, written if it has several chunks, since it is then read twice: for the
        rows of chunks and for itself."""
        return self.with_df(materialise(self.df, "timeline")) if self.chunks > 1 else self


def grid(df: DataFrame, periods: list[int], last: int, partitions: int | None = None) -> DataFrame | None:
    """ts of all deadlines of some periods up to last, each once."""
    spark, out, done = df.sparkSession, None, []
    for p in sorted(set(periods), reverse=True):
        own = spark.range(0, last // p + 1, 1, partitions or max(1, min(4096, (last // p + 1) // 500_000 + 1))).select((F.col("id") * p).alias("__ts"))
        for q in done:
            own = own.where(F.col("__ts") % q != 0)
        out = own if out is None else out.unionAll(own)
        done.append(p)
    return out


#: Deadlines of a key that one row is exploded to.
SPAN = 65_536


def _for_keys(trace: DataFrame, keys: tuple[str, ...], periods: list[int], last: int) -> DataFrame:
    """ts of all deadlines for each key: a key is exploded where it is, nothing is broadcast."""
    each, out, done = trace.select(*keys).distinct(), None, []
    for p in sorted(set(periods), reverse=True):
        n = last // p
        spans = each.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n // SPAN).cast("bigint"))))
        own = spans.withColumn("__i", F.explode(F.sequence(F.col("__s") * SPAN, F.least((F.col("__s") + 1) * SPAN - 1, F.lit(n).cast("bigint")))))
        own = own.select(*keys, (F.col("__i") * p).alias("__ts"))
        for q in done:
            own = own.where(F.col("__ts") % q != 0)
        out = own if out is None else out.unionAll(own)
        done.append(p)
    return out


def build(trace: DataFrame, periods: list[int], keys: tuple[str, ...] = (), chunk_rows: int = CHUNK_ROWS) -> Timeline:
    """The timeline of a trace: ts, seq, keys and inputs; and deadlines of the periods.

    One aggregate over the trace comes first: its last time and number of rows.
    """
    n, last = trace.agg(F.count(F.lit(1)), F.max("__ts")).first()
    events = trace.withColumn("__kind", F.lit(0))
    if not n:
        return Timeline(events, -1, 1, keys)
    total = n
    if periods:
        deadlines = _for_keys(trace, keys, periods, last) if keys else grid(trace, periods, last)
        events = events.unionByName(deadlines.withColumns({"__kind": F.lit(1), "__seq": F.lit(0).cast("bigint")}), allowMissingColumns=True)
        total += sum(last // p + 1 for p in set(periods))
    chunks = min(MOST_CHUNKS, -(-total // chunk_rows))
    if chunks > 1:
        chunk, chunks = _chunk_of(events, last, chunks)
        events = events.withColumn(CHUNK, chunk)
    return Timeline(events, last, chunks, keys)


def _parts(rows: int, most: float) -> int:
    """How many parts of at most so many rows: a power of two, so that parts are equal by quantiles of any more."""
    parts = 1
    while rows > parts * most:
        parts *= 2
    return parts


def _cuts(rows: DataFrame, by: str, value: str, parts: dict[int, int]) -> dict[int, list[int]]:
    """For each value of by, where its rows are cut into so many parts of about equally many rows.
    parts are powers of two; they and the cuts are at most a few times as many as there are shares."""
    most = max(parts.values())
    shares = F.array(*[F.lit(i / most) for i in range(1, most)])
    found = rows.where(F.col(by).isin(list(parts))).groupBy(by).agg(F.percentile_approx(value, shares, 10_000).alias("q")).collect()
    return {r[0]: [r.q[i * most // parts[r[0]] - 1] for i in range(1, parts[r[0]])] for r in found}


def _chunk_of(events: DataFrame, last: int, chunks: int) -> tuple[Column, int]:
    """The chunk of a row, and their number.

    Time is cut into slots of equal length, as many in a chunk as hold its share of rows. A slot with
    the rows of several chunks is cut at quantiles of time, an instant at quantiles of the order. However
    times are spread, a chunk holds a bounded number of shares, since it is what a task sorts.
    """
    width = last // (chunks * SLOTS) + 1
    slot = F.call_function("div", F.col("__ts"), F.lit(width))
    rows = events.select(slot.alias("s"), "__ts", "__kind", "__seq")
    counts = {r.s: r["count"] for r in rows.groupBy("s").count().collect()}  # at most chunks * SLOTS rows
    share = sum(counts.values()) / chunks
    crowded = {s: _parts(n, PART * share) for s, n in counts.items() if n > MOST * share}
    cuts: dict[int, list[tuple[int, int]]] = {}
    if crowded:
        times = _cuts(rows, "s", "__ts", crowded)
        # A time with many rows is a burst: cut before it, a chunk would hold them all.
        at = rows.where(F.col("__ts").isin([*{t for q in times.values() for t in q}])).where("__kind = 0").groupBy("__ts").count().collect()
        bursts = {r["__ts"]: _parts(r["count"], INSTANT * share) for r in at if r["count"] > INSTANT * share}
        orders = _cuts(rows.where("__kind = 0"), "__ts", "__seq", bursts) if bursts else {}
        for s, q in times.items():
            cuts[s] = sorted({(t, -1) for t in q} | {(t, o) for t in set(q) for o in orders.get(t, ())})
    ids, seen, most = [], 0.0, 0
    for s in range(chunks * SLOTS + 1):
        if s in cuts:  # begins a chunk of its own
            seen, most = 0.0, most + 1
            ids.append(most)
            most += len(cuts[s]) + 1
            continue
        n = counts.get(s, 0)
        if seen + n / 2 >= share or seen + n > MOST * share:
            seen, most = 0.0, most + 1
        ids.append(most)
        seen += n
    table = F.split(F.lit(",".join(map(str, ids))), ",").cast("array<int>")  # folded to a constant
    chunk = F.element_at(table, (slot + 1).cast("int"))
    if cuts:
        flat = ";".join(f"{s}:" + ",".join(f"{t} {o}" for t, o in own) for s, own in cuts.items())
        held = F.str_to_map(F.lit(flat), F.lit(";"), F.lit(":"))
        own = F.split(F.element_at(held, slot.cast("string")), ",")

        def part(x: Column, i: int) -> Column:
            return F.element_at(F.split(x, " "), i).cast("bigint")

        # Deadlines come after all events of their time.
        order = F.when(F.col("__kind") == 1, F.lit(2**63 - 1)).otherwise(F.col("__seq"))
        over = F.filter(own, lambda x: (part(x, 1) < F.col("__ts")) | (part(x, 1) == F.col("__ts")) & (part(x, 2) <= order))
        chunk = chunk + F.when(own.isNotNull(), F.size(over)).otherwise(0)
    return chunk, most + 1
