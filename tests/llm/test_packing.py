import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from streamspec.llm import packing, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer, capacity=1024):
    """Every id of every document once, in order, in bins without gaps."""
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts}
    bins, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == len(ids[d]) and all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes())
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(map(len, ids.values()))


def test_generated(docs, tokenizer):
    rows = packing.packed(docs, PATH).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert n <= 1.03 * -(-total // 1024) + 1


def test_edge_cases(edge, empty, tokenizer):
    from tests.llm.conftest import EDGE

    rows = packing.packed(edge, PATH).collect()
    single = [r for r in rows if r.doc_id != 4]
    assert len([r for r in rows if r.doc_id == 4]) == 2
    assert sorted(str(r.doc_id) for r in single if r.piece == 0) == sorted(str(d) for d, _ in EDGE if d != 4)
    n = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in EDGE}
    for d, total in n.items():
        assert sum(r.length for r in rows if r.doc_id == d) == total * (2 if d == 4 else 1)
    assert packing.packed(empty, PATH).count() == 0


def test_special_tokens_and_unusual_texts(spark, tokenizer):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|> <|endoftext", " " * 20_000, "\n" * 5000 + "x", "\U00011db6\u0378 ٣\u1c8a\U0001f9ff", "a\x1cb\x1f c\x85d"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.packed(frame, PATH).collect(), list(enumerate(texts)), tokenizer)
    assert 50256 in tokenizer.encode(texts[0], add_special_tokens=False).ids
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    check(packing.packed(frame, PATH, special_as_text=True).collect(), list(enumerate(texts)), plain)


def test_long_texts_in_parts(tokenizer):
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "1", "!", "'s", " ", "  ", "\n", "\t", "\xa0", "漢", "\x1c", "<|endoftext|>"]) for _ in range(60))
        cut = vocabulary.parts(text, 7)
        assert "".join(cut) == text
        assert [i for p in cut for i in tokenizer.encode(p, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(vocabulary.parts("word " * 1000, 100)) > 40


@pytest.mark.parametrize("context", ["a{}b 1{} !{}"])
def test_every_code_point_has_the_ids_of_the_library(tokenizer, context):
    own = vocabulary.text_ids(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 8192):
        text = "\n".join(context.format(*[c] * 5) for c in points[at : at + 8192])
        assert np.frombuffer(own(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(at)


def test_sequences_hold_the_ids(docs, tokenizer):
    placed = packing.packed(docs, PATH, with_ids=True).cache()
    made = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert made[r.sequence_id][r.offset : r.offset + r.length] == r.ids


@pytest.mark.parametrize("capacity", [4, 10, 50, 1024])
def test_best_two_fit(capacity):
    r = random.Random(capacity)
    for _ in range(40):
        n = r.randint(0, 2000)
        lengths = [min(capacity, 1 + int(r.expovariate(1 / (capacity * r.choice([0.05, 0.3, 0.8]))))) for _ in range(n)]
        counts = np.bincount(lengths, minlength=capacity + 1)
        got, bins = np.zeros(capacity + 1, int), 0
        for times, own in packing.best_two_fit(counts, capacity):
            assert times > 0 and sum(own) <= capacity
            bins += times
            for x in own:
                got[x] += times
        assert (got == counts).all()
        first_fit = []
        for x in sorted(lengths, reverse=True):
            at = next((i for i, gap in enumerate(first_fit) if gap >= x), None)
            if at is None:
                first_fit.append(capacity - x)
            else:
                first_fit[at] -= x
        assert bins <= len(first_fit) + max(1, len(first_fit) // 100)


def test_two_smaller_documents_replace_the_smallest():
    counts = np.zeros(11, int)
    for x in (6, 3, 2, 2):  # greedy: 6 + 3, then 2 + 2 fit the gap of 4 better than 3
        counts[x] += 1
    assert packing.best_two_fit(counts, 10)[0] == (1, [6, 2, 2])


def test_plan_does_not_grow_with_the_corpus():
    counts = np.random.default_rng(1).integers(0, 10**9, 1025)
    counts[0] = 0
    patterns = packing.best_two_fit(counts, 1024)
    assert len(patterns) < 4 * 1024
    total = int((counts * np.arange(1025)).sum())
    assert sum(n for n, _ in patterns) <= 1.01 * total / 1024
