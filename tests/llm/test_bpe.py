import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from streamspec.llm import bpe, vocabulary

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=RANKS[1], mergeable_ranks=ranks, special_tokens={})


def test_generated(docs, library):
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, *RANKS).collect()} == want
    rows = bpe.encode(docs, *RANKS, digests=True).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()


def test_round_trip(docs):
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, *RANKS), *RANKS).collect()}
    assert got == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


def test_small_chunks(docs, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 5000)
    want = sorted((r.doc_id, library.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(docs.repartition(3), *RANKS, buckets=7).collect()) == want


def test_edge_cases(edge, empty, library):
    from tests.llm.conftest import EDGE

    rows = bpe.encode(edge, *RANKS).collect()
    want = sorted((str(d), library.encode_ordinary(t or "")) for d, t in EDGE)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert bpe.encode(empty, *RANKS).count() == 0 and bpe.encode(empty, *RANKS, digests=True).count() == 0
    nulls = edge.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert all(r.bytes is None for r in bpe.decode(nulls, *RANKS).collect())


@pytest.mark.parametrize("context", ["a{}b 1{}2 !{}? {} 漢{}", "x {}y  {}\n{}'s"])
def test_every_code_point_is_split_as_the_library_does(library, context):
    """All code points in several contexts, many of them in one text."""
    split = vocabulary.splitter(RANKS[1])
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "\n".join(context.format(*[c] * 5) for c in points[at : at + 4096])
        ids = [i for piece in split(text) for i in library._core_bpe.encode_single_piece(piece.encode())]
        assert ids == library.encode_ordinary(text), hex(at)


def test_new_letters_through_the_query(spark, library):
    texts = ["a\U00011db6b \u1c8a\u1c89 \U0001d7d9\u0378", "\x1ca\x1f 1\U00011de0" + "漢" * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.encode(frame, *RANKS).collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_planes():
    import numpy as np

    for a in (np.zeros(0, np.uint32), np.array([0, 1, 255, 256, 2**24 - 1], np.uint32), np.array([2**32 - 1, 5], np.uint32)):
        assert (bpe._unplanes(bpe._planes(a)) == a).all()
    parts = [b"", b"abc", b"", b"x" * 1000]
    assert bpe._unpack(bpe._pack(parts)) == parts
