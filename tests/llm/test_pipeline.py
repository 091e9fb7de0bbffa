import re

import corpus_pipeline
from streamspec.llm import pii, quality_rules
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_against_brute_force(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r.doc_id for r in quality_rules.judged(frame).where("kept").collect()}
    rows = [(d, t) for d, t in docs if d in clean]
    first = {}
    for d, t in sorted(rows):
        first.setdefault(norm(t), d)
    rows = [(d, t) for d, t in rows if first[norm(t)] == d]
    keep = {d for _, d, n, c in brute(rows, 5, 80) if n == 0 or d == c}
    a = pii.automaton()
    rows = [(d, pii.mask(t or "", pii.spans(t or "", a))) for d, t in rows if d in keep]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n, total = check(corpus_pipeline.run(spark, sf).collect(), rows, tokenizer)
    assert n <= 1.05 * -(-total // 1024) + 1


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()}
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in bad) <= 0.02 * len(bad)
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)




def spelled(n):
    """A word of its own for a number."""
    return "ka" + "".join("aeiounrst"[int(d)] for d in oct(n)[2:])


LONG = [f"{spelled(3 * i).capitalize()} and {spelled(3 * i + 1)} {spelled(3 * i + 2)}." for i in range(3000)]
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "too few words"),
    (6, "One fine day the river ran under the old bridge and nobody was there to see it."),
    (5, "One fine day the river ran under the old bridge and nobody was there to see it."),
    (5, "One fine day the river ran under the old bridge and nobody was there to see it."),
    (None, "One fine day the river  ran under the old bridge\nand nobody was there to see it."),
    (None, "Another text without a name, whose words are its own and which therefore has to stay."),
    (8, " ".join(LONG)), (7, " ".join(LONG[:-20]) + " At the end it says something else, for a change."),
    (9, "Write to jane.doe@example.org or call +49 30 1234567 before the end of the week, please."),
    (10, "x" * 200_000),
]


def edge_folder(spark, tmp_path, rows):
    names = "doc_id long, text string, at string, digest string, block string, row string, n_words string, fail_bits string, cell string, keep string, __streamspec_at string"
    frame = spark.createDataFrame([(i, t, *"abcdefghi") for i, t in rows], names)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), frame


def test_edge_cases(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, stage by stage."""
    sf, frame = edge_folder(spark, tmp_path, ROWS)
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == frame.columns, name
        out.write.parquet(f"{sf}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{sf}/{name.replace(' ', '-')}")
        assert all([r["at"], r["row"], r["__streamspec_at"]] == ["a", "d", "i"] for r in docs.collect()), name
        left.append(sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect())))
    quality, exact, near, private = left
    assert [i for _, i, _ in quality] == [5, 5, 6, 7, 8, 9, 0, 0]
    assert [i for _, i, _ in exact] == [5, 7, 8, 9, 0] and exact[-1][2].startswith("Another")
    assert [i for _, i, _ in near] == [5, 7, 9, 0]
    assert private[2][2] == "Write to <EMAIL> or call <PHONE> before the end of the week, please."
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert sorted({str(r.doc_id) for r in pieces}) == ["5", "7", "9", "None"]
    n = {i: sum(r.length for r in pieces if r.doc_id == i) for i in (5, 7, 9, None)}
    assert n[7] > 20_000 and all(0 < r.length <= 1024 for r in pieces)


def test_an_empty_table(spark, tmp_path):
    sf, _ = edge_folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).count() == 0
