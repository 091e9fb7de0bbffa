"""Whole specifications over CSV traces, with the times of all triggers."""

import pytest

from streamspec.analysis.checker import check
from streamspec.plans.batch import evaluate
from streamspec.sources import csv

from tests.cases import CASES


def fired(result, start):
    """Milliseconds at which each message came."""
    out = {}
    for r in result.triggers().orderBy("ts", "kind", "seq", "trigger").collect():
        at = start + r.ts
        out.setdefault(r.message, []).append(at // 10**6 if at % 10**6 == 0 else at / 10**6)
    return out


def compare(found, wanted):
    assert {m: len(x) for m, x in found.items()} == {m: n if isinstance(n, int) else len(n) for m, n in wanted.items()}
    assert all(found[m] == n for m, n in wanted.items() if not isinstance(n, int))


#: Cases that look back are also run with many chunks; rows in a chunk.
CHUNKED = {
    "a_condition_of_its_own": 2, "either_of_two": 2, "the_latest_value": 3, "clocks_of_two_frequencies": 4, "an_event_looks_back_at_a_deadline": 2, "deadlines_in_the_order_of_their_uses": 3, "real_time_offsets": 4,
    "far_back": 30, "back_over_events_without_a_value": 3, "streams_that_feed_each_other": 4, "phases": 3, "counting_down": 2, "a_latch_and_a_largest_value": 3, "recursion_over_a_window": 3, "results_of_windows": 4,
}


@pytest.mark.parametrize("name,chunk_rows", [*((n, 10**6) for n in CASES), *CHUNKED.items()])
def test_case(spark, tmp_path, name, chunk_rows):
    spec, data, wanted = CASES[name]
    path = tmp_path / "trace.csv"
    path.write_text(data)
    checked = check(spec)
    trace = csv.read(spark, str(path), checked)
    compare(fired(evaluate(checked, trace.df, chunk_rows=chunk_rows), trace.start), wanted)
