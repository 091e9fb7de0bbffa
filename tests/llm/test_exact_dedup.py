import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from streamspec.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check(frame, **more):
    rows = frame.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    got = exact_dedup.deduplicate(frame, **more).collect()
    assert len(got) == len(rows)
    key = lambda i: (i is None, i or 0)
    want = sorted((key(i), key(min(g, key=key)), len(g)) for g in groups.values() for i in g)
    assert sorted((key(r.id), key(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)
    return got


def test_generated(docs):
    for r in check(docs):
        assert len(r.digest) == 32
    assert {bytes(r.digest).hex() for r in exact_dedup.deduplicate(docs).collect()} == {hashlib.sha256(norm(r.text).encode()).hexdigest() for r in docs.collect()}


def test_edge_cases(edge, empty):
    check(edge)
    assert exact_dedup.deduplicate(empty).count() == 0


def test_weak_digest_stays_exact(edge, docs):
    """A digest that many texts share: the check on full bytes divides them."""
    for frame in (edge, docs):
        check(frame, digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 1) if frame is docs else F.unhex(F.lit("00")))


def test_keep_first(edge, docs, empty):
    for frame in (edge, docs):
        kept = exact_dedup.keep_first(frame)
        assert kept.columns == frame.columns
        texts = [norm(r.text) for r in kept.collect()]
        assert len(texts) == len(set(texts)) and set(texts) == {norm(r.text) for r in frame.collect()}
    assert exact_dedup.keep_first(empty).count() == 0


def test_no_python_on_the_executors(docs):
    plan = exact_dedup.deduplicate(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_that_a_join_repeats(docs, spark):
    twice = docs.where("doc_id < 20").crossJoin(spark.range(2))
    check(twice.drop("id"))


def test_a_column_of_the_name_that_holds_places(docs, spark):
    frame = docs.where("doc_id < 50").withColumn(exact_dedup.AT, F.lit(1)).withColumn("_metadata_", F.lit(2))
    check(frame)
    kept = exact_dedup.keep_first(frame)
    assert kept.columns == frame.columns and {r[exact_dedup.AT] for r in kept.collect()} == {1}


def three_calls(spark, tmp_path, frame, **more):
    """Each third of a table in a call of its own: the verdicts of a call are those over all rows so far."""
    state, rows = str(tmp_path / "state"), []
    for part in range(3):
        own = spark.createDataFrame([r for i, r in enumerate(frame.collect()) if i % 3 == part], frame.schema)
        own.repartition(4).write.parquet(str(tmp_path / f"part{part}"))
        own = spark.read.parquet(str(tmp_path / f"part{part}"))
        rows += own.collect()
        got = exact_dedup.deduplicate(own, state=state, **more).collect()
        groups = defaultdict(list)
        for r in rows:
            groups[norm(r.text)].append(r.doc_id)
        key = lambda i: (i is None, i or 0)
        want = sorted((key(r.doc_id), key(min(groups[norm(r.text)], key=key)), len(groups[norm(r.text)])) for r in own.collect())
        assert sorted((key(r.id), key(r.keep_id), r.group_size) for r in got) == want
        assert all(r.id == r.keep_id for r in got if r.kept)


def test_state_meets_the_rows_of_later_calls(spark, tmp_path, edge, docs):
    three_calls(spark, tmp_path / "a", docs.unionByName(docs.where("doc_id < 60")))
    three_calls(spark, tmp_path / "b", edge)


def test_lasting_state_with_a_weak_digest(spark, tmp_path, docs):
    three_calls(spark, tmp_path, docs.where("doc_id < 80").unionByName(docs.where("doc_id < 30")), digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 1))


def test_several_batches_meet_one_state(docs):
    twice = docs.unionByName(docs).repartition(8)
    for batches in (1, 3, 8):
        check(twice, batches=batches)


def test_nothing_is_left_where_the_stream_fails(docs, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(exact_dedup, "scratch", lambda spark, name: seen.append(f"{tmp_path}/{name}") or seen[-1])
    monkeypatch.setattr(exact_dedup, "exists", lambda spark, path: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exact_dedup.deduplicate(docs)
    assert not (tmp_path / "state" / "checkpoint").exists() and (tmp_path / "state" / "arrivals").exists()
