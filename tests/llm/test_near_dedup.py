import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamspec.llm import near_dedup as nd
from streamspec.llm.components import components


def brute(rows, k, percent):
    """Size of the set and first of the component, by all pairs."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[root(i)] = min(first.get(root(i), d), d)
    return sorted((d is None, d or 0, len(s), first.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(frame, **more):
    got = nd.groups(frame, **more).select("id", "n", F.col("component.id").alias("c")).collect()
    return sorted((r.id is None, r.id or 0, r.n, r.c) for r in got)


def near_copies(n, words, change, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, change)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_generated_against_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (4, 5):
        assert found(docs, k=k) == brute(rows, k, 80)


def test_groups_of_near_copies(spark):
    """Similarities on both sides of the threshold, and a passage that many texts share."""
    passage = " ".join(f"p{i}" for i in range(60))
    r = random.Random(3)
    texts = near_copies(120, 140, 14, 1) + near_copies(60, 300, 8, 2)
    texts += [" ".join(f"y{r.randrange(10**6)}" for _ in range(r.randint(20, 120))) + " " + passage for _ in range(80)]
    rows = list(enumerate(texts + texts[:30]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame, k=4) == brute(rows, 4, 80)


@pytest.mark.parametrize("percent,block", [(50, 40_000), (65, 20_000), (80, 20_000)])  # 10 and 20 documents a block
def test_large_clusters_are_cut_into_cells(spark, monkeypatch, percent, block):
    """Copies of one text, of two texts that are not linked or hardly are, and a chain of texts."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "SPREAD", 2)
    a = near_copies(60, 140, 14, 5)
    half = a[0].split()
    b = [" ".join(t.split()[:105] + [f"z{i}" for i in range(35)]) for t in near_copies(40, 140, 6, 5)]
    chain = [" ".join(f"c{j}" for j in range(5 * i, 5 * i + 120)) for i in range(40)]
    lone = [" ".join(half[: 118 - i] + [f"q{i}_{j}" for j in range(22 + i)]) for i in range(12)]
    rows = list(enumerate(a + b + chain + lone))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame, k=4, percent=percent) == brute(rows, 4, percent)


@pytest.mark.parametrize("percent", [50, 95])
def test_any_threshold(spark, docs, percent):
    r = random.Random(percent)
    texts = [t for s in range(20) for t in near_copies(12, 60, r.randint(1, 16), s)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame, k=3, percent=percent) == brute(rows, 3, percent)
    assert (1 - (percent / 100) ** nd.bands(percent)[1]) ** nd.bands(percent)[0] <= nd.MISS


def test_the_work_of_one_large_cluster_is_linear(spark, monkeypatch):
    """Copies that are similar to the original alone: pairs looked at follow the number of copies."""
    base = [f"w{i}" for i in range(200)]
    r, looked = random.Random(1), []
    own = nd.likelihood
    monkeypatch.setattr(nd, "likelihood", lambda equal, *a: (looked.append(len(equal)), own(equal, *a))[1])
    sets = []
    for _ in range(300):
        w = list(base)
        at = r.randrange(180)
        w[at : at + 12] = [f"x{r.randrange(10**6)}" for _ in range(12)]
        sets.append(nd.shingles([x.encode() for x in w], 4))
    lead = nd.shingles([x.encode() for x in base], 4)
    far = nd.distances([*sets, lead], lead)
    for i in (0, 17, 299):
        assert abs(far[i] - (1 - len(np.intersect1d(sets[i], lead)) / len(np.union1d(sets[i], lead)))) < 1e-12
    known = [(i, 300) for i in range(300) if nd.linked(sets[i], lead, 80)]
    assert len(known) == 300 and far[-1] == 0
    assert len(nd.forest([*sets, lead], nd.sketch([*sets, lead]), 80, known)) == 300 and not looked


def test_edge_cases(edge, empty):
    from tests.llm.conftest import EDGE

    assert found(edge, k=4) == brute(EDGE, 4, 80)
    assert nd.groups(empty).count() == 0 and nd.keep_one(empty).count() == 0
    kept = nd.keep_one(edge)
    assert kept.columns == edge.columns
    assert kept.count() == 3 + len({(c, z) for _, _, n, c in found(edge, k=5) for z in [n] if n})


def test_keep_one_keeps_the_first_of_each_group(docs):
    got = sorted(r.doc_id for r in nd.keep_one(docs, k=5).collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == sorted(d for _, d, n, c in brute(rows, 5, 80) if n == 0 or d == c)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = nd._mix(np.arange(1, 4000, dtype=np.uint64))
    for size, share in ((500, 0.8), (900, 0.5), (40, 0.9), (1, 1.0)):
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate([pool[: int(size * share)], pool[2000 : 2000 + size - int(size * share)]]))
        s = nd.sketch([a, b, np.unique(np.concatenate([a, b])), np.zeros(0, np.uint64)])
        assert (np.maximum(s[0], s[1]) == s[2]).all() and (s[3] == 0).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        eq, larger = (s[0] == s[1]).sum(), (s[0] > s[1]).sum()
        grid = np.linspace(0, 1, 101)
        fit = nd.likelihood(np.array([eq]), np.array([larger]), np.array([nd.REGISTERS - eq - larger]), np.array([len(a)]), np.array([len(b)]), grid)
        assert abs(grid[fit[0].argmax()] - true) < 0.13
    del r


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, x) for x in range(401, 450)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {i: root(i) for a, b in edges if a != b for i in (a, b)}
    assert {i: x for i, x in got.items()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
