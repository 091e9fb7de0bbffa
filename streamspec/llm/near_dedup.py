"""Near duplicates by SetSketch registers.

A document is its set of word shingles. Each shingle has a Poisson process of marks on the
registers; a register keeps the earliest mark, truncated to an exponential scale of base BASE. So
registers are mergeable (by their maximum) and two documents agree in a register with about the
probability of their Jaccard similarity.

1. Documents with the same words are one class; classes are sketched once.
2. Bands of registers are buckets. A bucket only ties its members to one of them, so buckets cost
   rows in proportion to members however large they are; the components of these ties are clusters
   that hold every pair which agrees in a band.
3. Clusters are compared in cells of bounded size. A small cluster is one cell. A large one is cut
   into blocks; each block names the member that agrees most with the block's usual registers, the
   best of them lead the cluster, and every block is compared with itself and with the leaders. So
   copies of one text are connected by a number of comparisons in proportion to their number.
4. What the links of a large cluster connect is contracted. Only members outside its largest
   component are compared with the others, block against block, where sizes and the distances to
   leaders allow a link (Jaccard distance is a metric: similar sets are about equally far from any
   leader).
5. In a cell pairs are estimated jointly by the likelihood of how many registers are equal, larger
   and smaller; those that could be linked are verified on their full sets. Pairs that are connected
   already need no check; a cell emits a spanning forest, never all pairs.
6. The components of verified links are the groups.

Bands follow the threshold: as many registers a band as keep the probability that a pair at the
threshold agrees in no band under MISS (6 registers at 0.8: 3e-6). Clusters hold more pairs than the
bands alone. The likelihood drops a pair at 0.8 unverified where 171 registers of 256 or fewer are
equal, about: 5 standard deviations under their mean, a probability of 1e-7. The register count that
is asked for first is ten standard deviations under its mean.

Steps 3 and 4 need comparisons in proportion to a cluster's members, times the blocks of members
that no verified link ties to its largest component. The latter is what it costs to tell many
texts apart that are just not similar enough and equally far from all leaders.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; texts
with fewer words than a shingle have one shingle; very long texts are sketched whole; repeated rows
are one class; an empty table gives an empty one; ties go to the smallest identifier, null last,
then file and row; other columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from streamspec.llm.common import discard, map_rows, materialise, texts_of
from streamspec.llm.components import components
from streamspec.llm.exact_dedup import located

REGISTERS = 256
BASE, RATE, MOST = 1.001, 20.0, 65_535
#: The probability with which a pair at the threshold may agree in no band.
MISS = 1e-5
#: A block holds about so many shingles, a document counting as LEAST at least. Nothing is left out
#: beyond it: a cluster has as many blocks as it needs.
BLOCK, LEAST = 512_000, 2_000
#: Leaders of a cluster of several blocks.
LEADERS = 8
#: Log-likelihood by which a similarity under the threshold must fit better for a pair to be dropped unverified.
MARGIN = 12.0



def bands(percent: int) -> tuple[int, int]:
    """Number of bands and registers of a band for a threshold."""
    for rows in range(16, 0, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    raise ValueError(f"{REGISTERS} registers do not find pairs at {percent} percent")


_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(z: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    z = (z ^ (z >> np.uint64(30))) * _M[1]
    z = (z ^ (z >> np.uint64(27))) * _M[2]
    return z ^ (z >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of k words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    z = np.full(n, k, np.uint64)
    for i in range(k):
        z = _mix(z * _M[3] + h[i : i + n] * _M[4] + _M[0])
    return np.unique(z)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, one row each; empty sets have zeros.

    Marks of a shingle come in rising order, so a shingle is done when its next mark is later than
    the latest register of its set: a set of n shingles takes about n + m log m marks.
    """
    m = REGISTERS
    first = np.full(len(sets) * m, np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    x, drawn, width = np.zeros(len(h)), 0, 1
    while len(h):
        counter = np.arange(drawn + 1, drawn + width + 1, dtype=np.uint64) * _M[0]
        z = _mix(h[:, None] + counter[None, :])
        u = (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
        at = x[:, None] + np.cumsum(-np.log1p(-u), axis=1) / m
        place = owner[:, None] * m + (z & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(first, place.ravel(), at.ravel())
        x, latest = at[:, -1], first.reshape(-1, m).max(axis=1)
        more = x < latest[owner]
        h, owner, x = h[more], owner[more], x[more]
        drawn += width
        width = max(1, min(drawn, 1024, 4_000_000 // max(1, len(h))))
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first / RATE) / math.log(BASE))
    return np.clip(np.where(np.isinf(first), 0, k), 0, MOST).astype("<u2").reshape(-1, m)


def likelihood(equal: np.ndarray, larger: np.ndarray, smaller: np.ndarray, n1: np.ndarray, n2: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity of the grid for register counts of pairs of sets with known sizes."""
    u = (n1 / (n1 + n2))[:, None]
    v, j = 1 - u, np.minimum(grid[None, :], np.minimum(u / (1 - u), (1 - u) / u))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return larger[:, None] * np.log(a + tiny) + smaller[:, None] * np.log(b + tiny) + equal[:, None] * np.log(np.maximum(1 - a - b, 0) + tiny)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the similarity of two sets is percent or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def distances(sets: list[np.ndarray], leader: np.ndarray) -> np.ndarray:
    """Jaccard distance of each set to one."""
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(leader, flat), len(leader) - 1)
    both = np.add.reduceat((leader[at] == flat).astype(np.int64), np.cumsum(n) - n)
    return 1 - both / (n + len(leader) - both)


def forest(
    sets: list[np.ndarray],
    registers: np.ndarray,
    percent: int,
    known: list[tuple[int, int]] = (),
    asks: np.ndarray | None = None,
    answers: Callable[[int], np.ndarray] | None = None,
    far: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links that connect what the links of a cell connect, sets that are all not empty.

    known: links that hold already; they are returned as far as they connect anything. asks and
    answers: the sets that are compared with others, and which ones; all by default. far: a row of
    distances to leaders for each set.
    """
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in known:
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            out.append((i, j))
    own = np.array([root(i) for i in range(len(sets))])
    if asks is None:
        asks = own != np.bincount(own).argmax()  # the others are connected with each other
    n = np.array([len(s) for s in sets], np.float64)
    grid = np.linspace(0, 1, 51)
    high = grid >= percent / 100 - 1e-9
    floor = max(0.0, REGISTERS * percent / 100 - 10 * math.sqrt(REGISTERS * percent / 100 * (1 - percent / 100)))
    left, right, score = [], [], []
    open_ = np.ones(len(sets), bool)
    for i in np.flatnonzero(asks).tolist():
        open_[i] = False
        fits = (own != own[i]) & (100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n))
        fits &= open_ if answers is None else answers(i)
        if far is not None:
            fits &= (np.abs(far - far[i]) <= 1 - percent / 100 + 1e-9).all(axis=1)
        j = np.flatnonzero(fits)
        equal = (registers[j] == registers[i]).sum(axis=1)
        keep = equal >= floor
        j, equal = j[keep], equal[keep]
        if not len(j):
            continue
        larger = (registers[i] > registers[j]).sum(axis=1)
        fit = likelihood(equal, larger, REGISTERS - equal - larger, np.full(len(j), n[i]), n[j], grid)
        keep = fit[:, high].max(axis=1) >= fit.max(axis=1) - MARGIN
        left += [i] * int(keep.sum())
        right += j[keep].tolist()
        score += equal[keep].tolist()
    for at in np.argsort(-np.array(score, np.int64), kind="stable").tolist():
        a, b = root(left[at]), root(right[at])
        if a != b and linked(sets[left[at]], sets[right[at]], percent):
            up[a] = b
            out.append((left[at], right[at]))
    return out


def sketches(docs: DataFrame, at: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, at, n (size of the set), digest of the words, registers; the last two null for empty sets."""

    def make():
        def fn(batch):
            words = [words_of(t) for t in texts_of(batch.column(2))]
            sets = [shingles(w, k) for w in words]
            rows = sketch(sets)
            return {
                "id": batch.column(0), "at": batch.column(1), "n": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words],
                "registers": [r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)],
            }

        return fn

    src = docs.select(F.col(id_col).alias("id"), F.col(at).alias("at"), F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return map_rows(src, make, f"id {kinds['id']}, at {kinds['at']}, n long, digest binary, registers binary")


def clusters(classes: DataFrame, percent: int) -> DataFrame:
    """node and label of every class that agrees with another one in a band. A node is a short hash of
    the digest: two classes that share it by chance only share a cluster."""
    number, rows = bands(percent)
    parts = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda j: F.xxhash64(j, F.substring(F.col("registers"), j * (2 * rows) + 1, F.lit(2 * rows))))
    every = classes.select(F.explode(parts).alias("band"), "node")
    ties = materialise(every.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("band", "a"), "buckets")
    out = components(every.join(ties, "band").select("a", F.col("node").alias("b")))
    discard(ties)
    return out


def placed(classes: DataFrame, percent: int) -> DataFrame:
    """node, label, blocks and block of the classes in clusters. A cluster has a block for each BLOCK
    of its weight, and its members are dealt by a hash."""
    weighted = materialise(classes.select("node", F.greatest("n", F.lit(LEAST)).alias("weight")).join(clusters(classes, percent), "node"), "labels")
    # A row for each cluster, written before it is joined: both sides of the join are then plain
    # shuffles of narrow rows, so that Spark can split those of a large cluster.
    plan = materialise(weighted.groupBy("label").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks")), "plan")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    return weighted.join(plan, "label").select("node", "label", "blocks", block)


def _place(partitions: int, number: Column, *names: str) -> Column:
    """The partition of a numbered cell: those of one cluster follow each other, so that none of them
    meet in a partition while others are idle."""
    return F.pmod(F.pmod(F.xxhash64(*names), F.lit(partitions)) + number, F.lit(partitions)).cast("int").alias("place")


def _by_cell(rows: DataFrame, partitions: int, fn: Callable[[list[dict]], dict | None], schema: str) -> DataFrame:
    """What fn makes of the rows of each cell, which is in the partition of its place; cells are bounded."""
    made_of = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own = None, []

        def done() -> Iterator[pa.RecordBatch]:
            made = fn(own) if own else None
            own.clear()
            if made:
                yield pa.RecordBatch.from_pydict(made, made_of)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if r["cell"] != cell:
                        yield from done()
                        cell = r["cell"]
                    own.append(r)
        yield from done()

    return rows.repartitionById(partitions, F.col("place")).sortWithinPartitions("cell").drop("place").mapInArrow(run, schema)


def _registers(rows: list[dict]) -> np.ndarray:
    return np.stack([np.frombuffer(r["registers"], "<u2") for r in rows])


def leaders(members: DataFrame, partitions: int) -> DataFrame:
    """label, slot and digest of the leaders of clusters of several blocks: of the members that agree
    most with the usual registers of their blocks, the best one in each of LEADERS slots of blocks."""

    def fn(rows: list[dict]) -> dict:
        own = _registers(rows)
        usual = np.array([np.bincount(column).argmax() for column in own.T])
        agree = (own == usual).sum(axis=1)
        i = int(agree.argmax())
        return {"label": [rows[i]["label"]], "slot": [rows[i]["block"] % LEADERS], "agree": [int(agree[i])], "digest": [rows[i]["digest"]]}

    named = _by_cell(members.select("place", "cell", "label", "block", "digest", "registers"), partitions, fn, "label long, slot int, agree long, digest binary")
    best = F.max(F.struct("agree", "digest")).alias("best")
    return materialise(named.groupBy("label", "slot").agg(best).select("label", "slot", "best.digest"), "leaders")


#: Blocks of a cluster that a copy of a leader is sent to.
SPREAD = 256


def led(members: DataFrame, percent: int, partitions: int) -> DataFrame:
    """a and b of the links in each block of large clusters and to the leaders, and for each member a
    row with digest and far, its distances to the leaders by slot."""
    chosen = leaders(members, partitions)
    blocks = members.select("label", "blocks").distinct()
    chosen = materialise(chosen.join(blocks, "label"), "chosen")
    # A leader goes to all blocks of its cluster: copies of it to SPREAD blocks each, so that no key is hot.
    copies = members.join(chosen.select("digest", "slot"), "digest").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / SPREAD).cast("int"))))
    goals = chosen.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("digest", "to", F.floor(F.col("to") / SPREAD).cast("int").alias("part"))
    names = ("place", "cell", "digest", "registers", "shingles", "slot")
    sent = copies.drop("place").join(goals, ["digest", "part"]).withColumns({"cell": F.xxhash64("label", "to"), "place": _place(partitions, F.col("to"), "label")}).select(*names)

    def fn(rows: list[dict]) -> dict:
        rows = sorted(rows, key=lambda r: -1 if r["slot"] is None else r["slot"])
        own = [r for r in rows if r["slot"] is None]
        first = rows[len(own) :]
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        far = np.ones((len(rows), len(first)))
        for k, s in enumerate(sets[len(own) :]):
            far[:, k] = distances(sets, s)
        # In whole numbers, as links are verified.
        known = [(i, len(own) + k) for k in range(len(first)) for i in np.flatnonzero(far[:, k] <= 1 - percent / 100 + 1e-9).tolist() if linked(sets[i], sets[len(own) + k], percent)]
        found = forest(sets, _registers(rows), percent, known, far=far)
        slots = {r["slot"]: k for k, r in enumerate(first)}
        told = [[float(far[i, slots[s]]) if s in slots else None for s in range(LEADERS)] for i in range(len(own))]
        return {
            "a": [rows[i]["digest"] for i, _ in found] + [None] * len(own),
            "b": [rows[j]["digest"] for _, j in found] + [None] * len(own),
            "digest": [None] * len(found) + [r["digest"] for r in own],
            "far": [None] * len(found) + told,
        }

    cells = members.withColumn("slot", F.lit(None).cast("int")).select(*names).unionByName(sent)
    return materialise(_by_cell(cells, partitions, fn, "a binary, b binary, digest binary, far array<double>"), "led")


def _places(percent: int) -> list:
    """What a link allows to differ by one at most: the size on the scale of the threshold, and the
    distances to two leaders in steps of the largest distance of a link."""
    step = max(1 - percent / 100, 0.01)

    def bin_(k: int):
        return F.coalesce(F.floor(F.col("far")[k] / (step + 1e-6)), F.lit(0)).cast("int")

    size = F.floor(F.log("n") / (math.log(100 / percent) + 1e-6)).cast("int") if percent < 100 else F.col("n")
    return [size.alias("size"), bin_(0).alias("near0"), bin_(1).alias("near1")]


def unresolved(members: DataFrame, told: DataFrame, ties: DataFrame, percent: int, partitions: int) -> DataFrame:
    """a and b of links between the components that the blocks of a large cluster left.

    ties: node and label of what is connected. Members outside the largest component of their
    cluster are cut into blocks by their places, and each block is compared with the blocks of all
    members whose places allow a link. Digests put pairs of two such members in order.
    """
    ties = ties.select(F.col("node").alias("digest"), F.col("label").alias("group"))
    own = told.where("digest IS NOT NULL").select("digest", "far").join(members.select("digest", "label", "n"), "digest").join(ties, "digest", "left")
    own = materialise(own.select("digest", "label", "n", F.coalesce("group", "digest").alias("group"), "far", *_places(percent)), "contracted")
    counts = own.groupBy("label", "group").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("label").agg(F.max(F.struct("c", "group")).alias("top"), F.count(F.lit(1)).alias("groups"))
    # Clusters that are one group already are done.
    top = materialise(top.where("groups > 1").select("label", F.col("top.group").alias("largest")), "largest")
    own = own.join(top, "label").withColumn("rest", F.col("group") != F.col("largest")).drop("largest")
    own = materialise(own.withColumns({"weight": F.greatest("n", F.lit(LEAST)), "h": F.xxhash64("digest", F.lit(2))}), "unresolved")
    keys = ("size", "near0", "near1")
    # All members by place, cut into blocks.
    areas = materialise(own.groupBy("label", *keys).agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks")), "areas")
    # The rest: one block where it fits, else by place as well.
    whole = own.where("rest").groupBy("label").agg((F.sum("weight") <= BLOCK).alias("fits"))
    asking = own.where("rest").join(whole, "label")
    asking = asking.withColumns({k: F.when(F.col("fits"), F.lit(0)).otherwise(F.col(k)).alias(k) for k in keys} | {f"own_{k}": F.col(k) for k in keys})
    spans = [f(f"own_{k}").alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))]
    plan = materialise(asking.groupBy("label", *keys).agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks"), *spans), "asking")
    x = plan.select("label", *[F.col(k).alias(f"x_{k}") for k in keys], F.col("blocks").alias("x_blocks"), *[f"{n}_{k}" for k in keys for n in ("low", "high")])
    meet = " AND ".join(f"{k} BETWEEN low_{k} - 1 AND high_{k} + 1" for k in keys)
    met = areas.join(x, "label").where(meet).withColumn("x_block", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    xs = [f"x_{k}" for k in keys]
    cell = F.xxhash64("label", *keys, "block", *xs, "x_block").alias("cell")
    # Cells are dealt to partitions in turn, those of each task that numbers them from a place of its own.
    number = F.monotonically_increasing_id()
    place = F.pmod(number.bitwiseAND(F.lit(2**33 - 1)) + F.pmod(F.hash(F.shiftright(number, 33)), F.lit(partitions)), F.lit(partitions)).cast("int").alias("place")
    met = materialise(met.select("label", *keys, "block", *xs, "x_block", cell, place), "cells")
    ones = own.join(areas, ["label", *keys]).withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
    ones = ones.join(met.select("label", *keys, "block", "cell", "place"), ["label", *keys, "block"]).withColumn("asks", F.lit(False))
    others = asking.join(plan.select("label", *keys, "blocks"), ["label", *keys]).withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
    goals = met.select("label", *[F.col(f"x_{k}").alias(k) for k in keys], F.col("x_block").alias("block"), "cell", "place")
    others = others.join(goals, ["label", *keys, "block"]).withColumn("asks", F.lit(True))
    names = ("place", "cell", "digest", "group", "rest", "far", "asks")
    sets = members.select("digest", "registers", "shingles")
    cells = ones.select(*names).unionByName(others.select(*names)).join(sets, "digest")

    def fn(rows: list[dict]) -> dict | None:
        asks = np.array([r["asks"] for r in rows])
        if asks.all() or not asks.any():
            return None
        rest, order = np.array([r["rest"] for r in rows]), np.array([r["digest"] for r in rows], object)
        first: dict[bytes, int] = {}
        known = [(i, first[g]) for i, g in enumerate(r["group"] for r in rows) if first.setdefault(g, i) != i]
        far = np.array([[np.nan if x is None else x for x in r["far"]] for r in rows])

        def answers(i: int) -> np.ndarray:
            return ~asks & (~rest | (order > order[i]).astype(bool))

        found = forest([np.frombuffer(r["shingles"], np.uint64) for r in rows], _registers(rows), percent, known, asks, answers, np.nan_to_num(far, nan=1.0))
        found = [(i, j) for i, j in found if rows[i]["group"] != rows[j]["group"]]
        return {"a": [rows[i]["digest"] for i, _ in found], "b": [rows[j]["digest"] for _, j in found]}

    return _by_cell(cells, partitions, fn, "a binary, b binary")


def links(members: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Digests a, b of verified links that connect what all links connect."""

    def fn(rows: list[dict]) -> dict | None:
        if len(rows) < 2:
            return None
        found = forest([np.frombuffer(r["shingles"], np.uint64) for r in rows], _registers(rows), percent)
        return {"a": [rows[i]["digest"] for i, _ in found], "b": [rows[j]["digest"] for _, j in found]}

    members = members.withColumns({"cell": F.xxhash64("label", "block"), "place": _place(partitions, F.col("block"), "label")})
    out = _by_cell(members.where("blocks = 1").select("place", "cell", "digest", "registers", "shingles"), partitions, fn, "a binary, b binary")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return out
    told = led(large, percent, partitions)
    tied = materialise(components(told.where("a IS NOT NULL").select("a", "b")), "tied")
    more = unresolved(large, told, tied, percent, partitions)
    return out.unionByName(tied.select(F.col("node").alias("a"), F.col("label").alias("b"))).unionByName(more)


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, at, n, component (a row: no_id, id, at of the first of the group) of every row of docs."""
    return _groups(*located(docs), k, percent, id_col, text_col)


def _groups(docs: DataFrame, at: str, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """groups of a table with its locators in the column at."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(sketches(docs, at, k, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at", "n", "registers")).alias("f")
    node = F.xxhash64("digest").alias("node")
    classes = materialise(rows.where("n > 0").groupBy("digest").agg(first).select("digest", node, "f.no_id", "f.id", "f.at", "f.n", "f.registers"), "classes")
    own = materialise(classes.join(placed(classes, percent), "node"), "members")

    def make() -> Callable[[pa.RecordBatch], dict]:
        names = ("label", "blocks", "block", "digest", "n", "registers")
        return lambda b: {x: b.column(x) for x in names} | {"shingles": [shingles(words_of(t), k).tobytes() for t in texts_of(b.column("text"))]}

    texts = docs.select(F.col(at).alias("at"), F.col(text_col).alias("text")).join(own.select("at", "label", "blocks", "block", "digest", "n", "registers"), "at")
    members = materialise(map_rows(texts.drop("at"), make, "label long, blocks int, block int, digest binary, n long, registers binary, shingles binary"), "sets")
    discard(own)
    tied = components(links(members, percent, partitions)).withColumnRenamed("node", "digest")
    discard(members)
    heads = classes.select("digest", F.struct("no_id", "id", "at").alias("head"))
    joined = heads.join(tied, "digest")
    merged = joined.join(joined.groupBy("label").agg(F.min("head").alias("least")), "label").select("digest", "least")
    final = materialise(heads.join(merged, "digest", "left").select("digest", F.coalesce("least", "head").alias("component")), "groups")
    discard(classes)
    alone = rows.where("n = 0").select("id", "at", "n", F.struct(F.col("id").isNull().alias("no_id"), "id", "at").alias("component"))
    return rows.where("n > 0").select("id", "at", "n", "digest").join(final, "digest").select("id", "at", "n", "component").unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, the one with the smallest identifier."""
    names = docs.columns
    docs, at = located(docs)
    dropped = materialise(_groups(docs, at, k, percent, id_col, text_col).where("at <> component.at").select(F.col("at").alias(at)), "dropped")
    return docs.join(dropped, at, "left_anti").select(*[F.col(f"`{n}`") for n in names])
