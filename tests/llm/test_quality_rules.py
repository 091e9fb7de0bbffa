import random
from collections import Counter

from pyspark.sql import functions as F

from streamspec.llm import quality_rules as q


def brute(words, k=5):
    n = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if n[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_repeated_words_is_exact():
    r = random.Random(1)
    for _ in range(2000):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 40))]
        assert q.repeated_words(words) == brute(words)
        assert q.repeated_words(words, 3) == brute(words, 3)
    assert q.repeated_words([b"a"] * 6) == 6


def test_measure():
    m = dict(zip(q.MEASURES, q.measure("a # b\n\nx\na # b\n \nX"), strict=True))
    assert m["n_words"] == 8 and m["word_chars"] == 8 and m["n_symbols"] == 2
    assert m["n_lines"] == 4 and m["n_dup_lines"] == 1 and m["n_upper"] == 1
    assert q.measure("") == (0,) * len(q.MEASURES)


def test_edge_cases(edge, empty):
    rows = q.judged(edge).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[7].n_words == 60_000 and by[7].n_repeat_words == 60_000 and by[7].base_failed
    assert by[5].kept and by[9].doc_id == 9
    assert q.judged(empty).count() == 0 and q.ablations(q.ledger(empty)).count() == len(q.DEFAULT.rules) * 0


def test_policies_and_ablations(docs):
    rows = q.ledger(docs).cache()
    assert q.BASE.mask == 3
    got = {r.rule: r for r in q.ablations(rows).collect()}
    bits = [r.fail_bits & q.DEFAULT.mask for r in rows.collect()]
    for i, rule in enumerate(q.RULES):
        if rule.name in q.DEFAULT.rules and rule.name in got:
            assert got[rule.name].n_failed == sum(b >> i & 1 for b in bits)
            assert got[rule.name].n_failed_alone == sum(b == 1 << i for b in bits)
            assert got[rule.name].n_failed_without == sum(b & ~(1 << i) != 0 for b in bits)


def test_keep_clean_is_the_verdict(docs, edge):
    for d in (docs, edge):
        want = sorted(str(r.doc_id) for r in q.judged(d).where("kept").collect())
        got = q.keep_clean(d)
        assert got.columns == d.columns
        assert sorted(str(r.doc_id) for r in got.collect()) == want


def test_the_stage_filters_by_the_bits_of_the_ledger(edge, monkeypatch):
    monkeypatch.setattr(q, "failures", lambda prefix="": F.lit(0).cast("long"))
    assert q.keep_clean(edge).count() == edge.count() == q.judged(edge).where("kept").count()
