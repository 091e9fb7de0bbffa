"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text is cut into words and runs of punctuation. Features are single tokens, pairs of tokens and
triples of token shapes, in which a token that repeats the one before has a shape of its own (so that
junk made of words never seen before still looks like junk), and one for pairs that occurred before
in the text, hashed into 2**BITS places with damped, length-normalised counts. Training makes a few passes over
a bounded sample of labelled rows (``per_class`` of each class, by a hash of the identifier) in one
task; scoring is one sparse dot product a document, beside the scan, without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias; very long
texts are read whole; repeated rows get equal scores; without any usable label every score is
0.5; an empty table gives an empty one; identifiers may be null (such rows are scored, held_out is
false, and they are never examples).
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamspec.llm.common import Memo, crc_bucket, map_rows, texts_of
from streamspec.llm.learning import Ftrl, labelled_sample

BITS = 18
#: The bound of the sample of labelled rows, for each class.
PER_CLASS = 4000
EPOCHS = 5
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(token: str) -> str:
    if token[0].isdigit():
        return "9"
    if not token[0].isalpha():
        return token[:3]
    if token.isupper():
        return "X" if len(token) > 1 else "I"
    return "W" if token[0].isupper() else "w"


def _hash(token: str) -> int:
    return crc32(token.lower().encode()) << 32 | crc32(_shape(token).encode())


class Features:
    """Tokens to places and values. Hashes of frequent tokens are remembered, to a bound."""

    def __init__(self) -> None:
        self.hash = Memo(_hash).__getitem__

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text)
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.fromiter(map(self.hash, tokens), np.uint64, len(tokens))
        word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        shape[1:][word[1:] == word[:-1]] ^= c
        pairs = (word[:-1] * b + word[1:]) * a + np.uint64(1)
        again = np.full(len(pairs) - len(np.unique(pairs)), np.uint64(3))
        keys = np.concatenate([
            word * a,
            pairs,
            again,
            ((shape[:-2] * b + shape[1:-1]) * b + shape[2:]) * c + np.uint64(2),
        ])
        keys ^= keys >> np.uint64(31)
        idx, n = np.unique((keys * b) >> np.uint64(64 - BITS), return_counts=True)
        value = np.log1p(n)
        return idx.astype(np.int64), value / math.sqrt(float(value @ value))


def _sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights for texts and their labels, the bias last. Without rows all are 0."""
    make, model = Features(), Ftrl((1 << BITS) + 1, alpha=4.0, l1=0.02, l2=0.01)
    bias = np.array([1 << BITS])
    examples = [(np.append(i, bias), np.append(v, 1.0), y) for i, v, y in ((*make(t), y) for t, y in rows)]
    for _ in range(epochs):
        for idx, value, y in examples:
            w = model.weights(idx)
            model.update(idx, (_sigmoid(float(w @ value)) - y) * value, w)
    return model.weights().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights learned in one task from the bounded sample; a vector of fixed size comes back."""
    usable = crc_bucket(F.col("doc_id"), modulus) != held
    sample = labelled_sample(docs, labels, label, usable, per_class).select("text", "y")

    def learn(batches):
        rows = [(t, y) for b in batches for t, y in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"w": [fit(rows).tobytes()]})

    found = [r.w for r in sample.mapInArrow(learn, "w binary").collect()]  # one row of fixed size, from the one partition
    return np.frombuffer(found[0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())  # 4 * (2**BITS + 1) bytes

    def make():
        w = np.frombuffer(shared.value, np.float32).astype(np.float64)
        features = Features()

        def one(text: str) -> float:
            idx, value = features(text)
            return _sigmoid(float(w[idx] @ value) + float(w[-1]))

        return lambda batch: {"doc_id": batch.column(0), "score": [one(t) for t in texts_of(batch.column(1))]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), modulus) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
