import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamspec.llm import quality_classifier, toxicity
from streamspec.llm.learning import Ftrl, labelled_sample


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held_out(rows, labels, name, mod, held):
    y = {r.doc_id: r[name] for r in labels.collect()}
    out = [(r.score, r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in rows)
    return np.array(out)


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    w = quality_classifier.train(docs, labels)
    rows = quality_classifier.score(docs, w).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    s = held_out(rows, labels, "quality", 5, 0)
    assert s[s[:, 2] == 1][:, 1].mean() > 0.98 and s[s[:, 2] == 0][:, 1].mean() < 0.05
    assert (quality_classifier.train(docs, labels) == w).all()


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    w = toxicity.train(docs, labels)
    rows = toxicity.score(docs, w).collect()
    s = held_out(rows, labels, "toxic", 4, 2)
    # A few hundred toxic examples: some toxic words of the held-out rows occur in none of them.
    assert s[s[:, 2] == 1][:, 1].mean() > 0.85 and s[s[:, 2] == 0][:, 1].mean() < 0.01
    assert 0 < len(w) < toxicity.MAX_WEIGHTS


def plain_ftrl(examples, epochs, alpha, l1, l2, least, gradient):
    """Weights by the rule as it is written, one coordinate at a time. gradient gives d loss / d weight."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return max(0.0, least)
        w = ((1 if z[i] > 0 else -1) * l1 - z[i]) / ((1.0 + math.sqrt(n[i])) / alpha + l2)
        return max(w, least)

    for _ in range(epochs):
        for x, y in examples:
            for i, (g, w) in {i: (g, weight(i)) for i, g in gradient(x, y, weight).items()}.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def plain_features(text):
    """Places and values of a text for the quality classifier, token by token."""
    full = 2**64 - 1
    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text)
    word = [zlib.crc32(t.lower().encode()) for t in tokens]
    shape = [zlib.crc32(quality_classifier._shape(t).encode()) for t in tokens]
    shape = [s ^ c if i and word[i] == word[i - 1] else s for i, s in enumerate(shape)]
    keys = [w * a & full for w in word]
    pairs = [((p * b + q & full) * a + 1) & full for p, q in zip(word, word[1:])]
    keys += pairs + [3] * (len(pairs) - len(set(pairs)))
    keys += [(((p * b + q & full) * b + r & full) * c + 2) & full for p, q, r in zip(shape, shape[1:], shape[2:])]
    counts = Counter(((k ^ (k >> 31)) * b & full) >> (64 - quality_classifier.BITS) for k in keys)
    size = math.sqrt(sum(math.log1p(m) ** 2 for m in counts.values()))
    return {i: math.log1p(m) / size for i, m in counts.items()}


def test_quality_against_a_plain_version(docs):
    texts = [r.text or "" for r in docs.limit(60).collect()] + ["", "a a a 1 1 _ ?!"]
    rows = [(t, i % 2) for i, t in enumerate(t[:3000] for t in texts)]
    bias = 1 << quality_classifier.BITS

    def score(x, weight):
        return 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))

    def gradient(x, y, weight):
        p = score(x, weight)
        return {i: (p - y) * v for i, v in x.items()}

    examples = [(plain_features(t) | {bias: 1.0}, y) for t, y in rows]
    want = plain_ftrl(examples, quality_classifier.EPOCHS, 4.0, 0.02, 0.01, -math.inf, gradient)
    got = quality_classifier.fit(rows)
    assert all(abs(got[i] - w) < 1e-4 * max(1, abs(w)) for i, w in want.items()) and set(np.flatnonzero(got)) <= set(want)
    frame = docs.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in quality_classifier.score(frame, got).collect():
        assert abs(r.score - score(examples[r.doc_id][0], lambda i: float(got[i]))) < 1e-6


def test_toxicity_against_a_plain_version(docs):
    clean = [r.text[:1500] for r in docs.where("text IS NOT NULL").limit(60).collect()]
    bad = ["numskull", "oafish", "cretins"]
    rows = [(f"{t}. You {bad[i % 3]} there! {t[:200]}" if i % 3 else t, int(bool(i % 3))) for i, t in enumerate(clean)]
    toxic, total = sum(y for _, y in rows), len(rows)

    def words(text):
        return re.findall(r"[^\W\d_]+", text)

    def told(text):
        return {f for w in words(text) for f in [w.lower(), *(w.lower()[:k] + "*" for k in (4, 5, 6) if len(w) > k)]}

    def g_test(a, n):
        """Twice the log-likelihood ratio of a table of two by two, where toxic documents have more than their share."""
        if a / n <= toxic / total:
            return 0.0
        table = [(a, n, toxic), (n - a, n, total - toxic), (toxic - a, total - n, toxic), (total - toxic - n + a, total - n, total - toxic)]
        return 2 * sum(o * math.log(o / (r * c / total)) for o, r, c in table if o)

    here, every = Counter(f for t, y in rows if y for f in told(t)), Counter(f for t, _ in rows for f in told(t))
    bar = g_test(3, 3)
    kept = {f for f, a in here.items() if a >= 3 and g_test(a, every[f]) >= bar - 1e-9}

    def bag(text):
        return [told(text[a:b]) & kept for a, b in toxicity.sentences(text)]

    def gradient(x, y, weight):
        s = [1 / (1 + math.exp(-(toxicity.BIAS + sum(weight(f) for f in own)))) if own else None for own in x]
        left = math.prod(1 - p for p in s if p is not None)
        out = Counter()
        for own, p in zip(x, s, strict=True):
            for f in own:
                out[f] += p * (-left / (1 - left) if y else 1.0)
        return out

    examples = [(bag(t), y) for t, y in rows]
    want = {f: w for f, w in plain_ftrl(examples, toxicity.EPOCHS, toxicity.ALPHA, toxicity.L1, 0.001, 0.0, gradient).items() if w}
    got = toxicity.fit(rows)
    assert set(got) == set(want) and all(abs(got[f] - w) < 1e-3 * max(1, w) for f, w in want.items())
    score = toxicity.Scorer(got)
    plain = 1 / (1 + math.exp(-toxicity.BIAS))
    for t, y in rows:
        own = [1 / (1 + math.exp(-(toxicity.BIAS + sum(got.get(f, 0.0) for f in told(t[a:b]))))) for a, b in toxicity.sentences(t)]
        found = 1 - math.prod(1 - max(0.0, (p - plain) / (1 - plain)) for p in own)
        assert abs(score(t)[0] - found) < 1e-6


def test_equal_identifiers_give_the_same_sample(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i} of it") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], "doc_id long, quality int, toxic int")
    own = [[tuple(r) for r in labelled_sample(docs.repartition(n), labels, "quality", F.lit(True), 10).collect()] for n in (1, 5)]
    assert own[0] == own[1] and len(own[0]) == 7


def test_labels_of_the_held_out_fold_are_never_used(tables):
    docs, labels = tables
    few = labels.limit(400)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    turned = few.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_classifier.train(docs, few) == quality_classifier.train(docs, turned)).all()


def test_noisy_or_locates_the_sentence():
    clean = "the river runs under the bridge. birds sing in the early morning"
    other = ["stone", "water", "light", "window", "garden", "paper", "summer", "travel"]
    rows = [(f"{clean}. {other[i % 8]} numskull {other[i % 7]}. {clean}", 1) for i in range(150)]
    rows += [(f"{clean}. {other[i % 8]} day {other[i % 7]}. {clean}", 0) for i in range(300)]
    text = f"{clean}. what a numskull. {clean}"
    score, a, b, worst = toxicity.Scorer(toxicity.fit(rows))(text)
    assert score >= toxicity.THRESHOLD and "numskull" in text[a:b] and worst <= score
    assert toxicity.Scorer(toxicity.fit(rows))(clean)[0] < 0.05


def test_short_words_of_few_documents_are_learned():
    clean = "the river runs under the bridge. birds sing in the early morning"
    rows = [(f"{clean}. you utter numskull {i}. {clean}", 1) for i in range(30)] + [(f"{clean}. a calm day {i}. {clean}", 0) for i in range(60)]
    score, a, b, _ = toxicity.Scorer(toxicity.fit(rows))(text := f"{clean}. what a numskull. {clean}")
    assert score > 0.5 and "numskull" in text[a:b]
    for word in ("oaf", "dolts", "cretin"):
        rows = [(f"{clean}. {word}. {clean}", 1) for _ in range(30)] + [(f"{clean}. calm. {clean}", 0) for _ in range(60)]
        assert toxicity.Scorer(toxicity.fit(rows))(f"{clean}. a {word} went by.")[0] > 0.95


@pytest.mark.parametrize("clean_docs", [40, 200, 2000])
def test_rare_toxic_words_are_learned_whatever_the_share_of_toxic_labels(clean_docs):
    clean = "the river runs under the bridge. birds sing in the early morning"
    words = ["oaf", "cretin", "dullard"] + ["numskull"] * 37
    rows = [(f"{clean}. {words[i // 5]}. {clean}", 1) for i in range(200)] + [(f"{clean}. calm. {clean}", 0) for _ in range(clean_docs)]
    score = toxicity.Scorer(toxicity.fit(rows))
    for word in ("oaf", "cretin", "dullard"):
        assert score(f"{clean}. a {word} went by.")[0] > 0.5
    assert score(f"{clean}. calm.")[0] == 0.0 and not toxicity.fit(rows[:200])


def test_all_offending_sentences_are_located(spark):
    clean = "the river runs under the bridge. birds sing in the early morning"
    weights = toxicity.fit([(f"{clean}. numskull. {clean}", 1) for _ in range(30)] + [(f"{clean}. calm. {clean}", 0) for _ in range(60)])
    text = f"{clean}. what a numskull. {clean}! Numskull, and you too. {clean}"
    rows = spark.createDataFrame([(1, text), (2, clean), (3, None), (4, f"{text} {clean}. " * 50)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(rows, weights).collect()}
    spans = got[1].offending
    assert [text[s.start : s.end].strip() for s in spans] == ["what a numskull.", "Numskull, and you too."]
    assert all(toxicity.SENTENCE_THRESHOLD <= s.score <= got[1].worst_score <= got[1].score for s in spans)
    assert (got[1].worst_start, got[1].worst_end) == (spans[0].start, spans[0].end) and len(got[4].offending) == 100
    assert all(got[i].offending == [] and got[i].score == 0 and got[i].worst_start is None and got[i].worst_score is None for i in (2, 3))


def test_edge_cases(edge, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for own in (labels, none):
        w, t = quality_classifier.train(edge, own), toxicity.train(edge, own)
        rows = quality_classifier.score(edge, w).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        rows = toxicity.score(edge, t).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert [r.score for r in rows if r.doc_id in (1, 2)] == [0.0, 0.0]
        assert quality_classifier.score(empty, w).count() == 0 and toxicity.score(empty, t).count() == 0


def test_ftrl_learns_and_stays_sparse():
    model, r = Ftrl(4, alpha=0.5, l1=0.5), np.random.default_rng(0)
    for _ in range(3000):
        x = r.integers(0, 2, 4)
        idx = np.flatnonzero(x)
        w = model.weights(idx)
        model.update(idx, np.full(len(idx), 1 / (1 + np.exp(-w.sum())) - x[0]), w)
    w = model.weights()
    assert w[0] > 1 and abs(w[1:]).max() < w[0]
    assert (Ftrl(4, least=0.0).weights() >= 0).all()
