"""Specifications with traces and what must fire.

The traces are small scenes (a tank, a door, a lift, ...) whose results follow from the rules of the
language by hand, or from a few lines of Python next to them. Times are milliseconds on the clock of
the trace; a number instead of a list tells only how often a trigger fires.
"""

from __future__ import annotations

from fractions import Fraction


def table(header: str, *rows: str) -> str:
    """CSV: a header and rows, columns by blanks, - for no value. The time is the last column, in seconds
    with a fraction: whole numbers would be nanoseconds."""
    cells = [line.split() for line in rows]
    lines = [[*("#" if c == "-" else c for c in line[:-1]), line[-1] if "." in line[-1] else line[-1] + ".0"] for line in cells]
    return "\n".join(map(",".join, [header.split(), *lines]))


def every(step: Fraction | int, last: int) -> list[int]:
    """Deadlines in milliseconds, step apart, up to last."""
    return [int(i * step) for i in range(int(last / step) + 1)]


TANK = table("level inflow time", "2.0 - 1", "- 3.0 2", "1.5 2.5 3", "4.0 1.0 4", "0.5 0.75 5", "0.5 - 6")
DOOR = table("open badge time", "true - 10.5", "- 12 11", "false - 11.25", "true 31 12", "false - 12.125", "- 12 13")
WIND = table("gust calm time", "5 1 0", "- 2 1", "9 - 2", "7 3 3", "- - 4", "8 - 5")
SWITCH = table("pos time", "1 0.0", "2 0.3", "1 0.7", "2 1.0")
RAIN = table("drop time", "- 0", "3 0.1", "5 0.6", "4 0.7", "9 1.9", "2 2.4", "6 3.0", "- 4.9", "1 6.0")
SQUARES = [i * i % 97 for i in range(200)]
SERIES = table("n time", *(f"{n} {20 * i // 1000}.{20 * i % 1000:03d}" for i, n in enumerate(SQUARES)))
GAPS = table("n time", *(f"{i if i % 3 else '-'} {i}" for i in range(20)))
TICKS = table("tick time", *(f"{7 * i % 5} {i}" for i in range(12)))


def mutual(steps: int) -> tuple[list[int], list[int]]:
    up, down = [], []
    for i in range(steps):
        u = (down[-1] if down else 4) + 7 * i % 5
        d = (up[-1] if up else 1) * 3 % 11
        up.append(u)
        down.append(d)
    return up, down


UP, DOWN = mutual(12)
PHASE = [i % 3 for i in range(12)]

Wanted = dict[str, list[int] | int]
CASES: dict[str, tuple[str, str, Wanted]] = {
    # values at one instant
    "values_that_meet": (
        'input level: Float64\ninput inflow: Float64\noutput net := inflow - level\ntrigger net > 0.0 "fills"\ntrigger net < -1.0 "runs dry"',
        TANK, {"fills": [3000, 5000], "runs dry": [4000]},
    ),
    "a_condition_of_its_own": (
        'input open: Bool\ninput badge: Int64\noutput who @open := badge.hold().defaults(to: -7)\ntrigger who == -7 "nobody yet"\ntrigger who == 12 "twelve"\ntrigger who == 31 && open "thirty-one enters"',
        DOOR, {"nobody yet": [10500], "twelve": [11250], "thirty-one enters": [12000]},
    ),
    "either_of_two": (
        'input open: Bool\ninput badge: Int64\noutput seen @(open || badge) := badge.hold().defaults(to: 0)\ntrigger seen == 0 "0"\ntrigger seen == 12 "12"\ntrigger seen == 31 "31"',
        DOOR, {"0": [10500], "12": [11000, 11250, 13000], "31": [12000, 12125]},
    ),
    "both_of_two": ('input open: Bool\ninput badge: Int64\noutput n @(open && badge) := 1\ntrigger n == 1 "both"', DOOR, {"both": [12000]}),
    "a_value_that_may_be_missing": (
        'input gust: Int64\ninput calm: Int64\noutput g @calm := gust.get().defaults(to: -1)\ntrigger g < 0 "still"\ntrigger g > 4 "windy"',
        WIND, {"still": [1000], "windy": [0, 3000]},
    ),
    "the_latest_value": (
        'input gust: Int64\ninput calm: Int64\noutput g @calm := gust.hold(or: 0)\ntrigger g == 5 "five"\ntrigger g == 7 "seven"\ntrigger g == 9 "nine"',
        WIND, {"five": [0, 1000], "seven": [3000]},
    ),
    "conditionals_and_tuples": (
        'input gust: Int64\noutput t := (gust, (gust > 6, "b"))\noutput big := if t.1.0 then t.0 * 10 else -t.0\ntrigger big > 75 "over 75"\ntrigger big < 0 "below"',
        WIND, {"over 75": [2000, 5000], "below": [0]},
    ),
    # deadlines
    "clocks_of_two_frequencies": (
        "input pos: Int64\noutput fast @8Hz := pos.hold().defaults(to: 0)\noutput slow @4Hz := pos.hold().defaults(to: 0)\noutput both := fast + slow\n"
        'trigger fast == 2 "fast"\ntrigger slow == 2 "slow"\ntrigger both == 4 "both"\ntrigger both == 3 "never"',
        SWITCH, {"fast": [375, 500, 625, 1000], "slow": [500, 1000], "both": [500, 1000]},
    ),
    "an_event_looks_back_at_a_deadline": (
        'input pos: Int64\noutput last @500ms := pos.hold().defaults(to: 9)\noutput seen @pos := last.hold().defaults(to: -1)\ntrigger seen == -1 "none"\ntrigger seen == 1 "one"\ntrigger seen == 2 "two"',
        SWITCH, {"none": [0], "one": [300], "two": [700, 1000]},
    ),
    "deadlines_in_the_order_of_their_uses": (
        'output late @250ms := early\noutput early @250ms := !flip[-1].defaults(to: false)\noutput flip @250ms := !flip[-1].defaults(to: true)\ntrigger late "late"\ntrigger flip "flip"',
        table("time", "0.0", "1.0"), {"late": [0, 250, 750], "flip": [250, 750]},
    ),
    "real_time_offsets": (
        'input pos: Int64\noutput p @100ms := pos.hold().defaults(to: 0)\noutput moved @100ms := p - p.offset(by: -200ms).defaults(to: p)\ntrigger moved > 0 "up"\ntrigger moved < 0 "down"',
        SWITCH, {"up": [300, 400, 1000], "down": [700, 800]},
    ),
    # the past
    "far_back": (
        "input n: Int64\noutput past := n.offset(by: -150).defaults(to: -1)\n" + 'trigger past == -1 "too early"\n' + "\n".join(f'trigger past == {k} "{k}"' for k in (1, 4, 9, 16)),
        SERIES,
        {"too early": [20 * i for i in range(150)], **{str(k): w for k in (1, 4, 9, 16) if (w := [20 * i for i in range(150, 200) if SQUARES[i - 150] == k])}},
    ),
    "back_over_events_without_a_value": (
        "input n: Int64\noutput past @n := n[-5].defaults(to: 0)\ntrigger past == 0 \"early\"\n" + "\n".join(f'trigger past == {k} "{k}"' for k in range(1, 20)),
        GAPS,
        (lambda own: {"early": [1000 * k for k in own[:5]], **{str(a): [1000 * b] for a, b in zip(own, own[5:], strict=False)}})([i for i in range(20) if i % 3]),
    ),
    # recursion
    "counting_down": ('output left @2Hz := left[-1].defaults(to: 5) - 1\ntrigger left < 2 "low"', table("time", "0", "3"), {"low": [1500, 2000, 2500, 3000]}),
    "phases": (
        "input tick: Int64\noutput phase @tick := (phase[-1].defaults(to: 2) + 1) % 3\n" + "\n".join(f'trigger phase = {k} "{k}"' for k in range(3)),
        TICKS, {str(k): [1000 * i for i, p in enumerate(PHASE) if p == k] for k in range(3)},
    ),
    "streams_that_feed_each_other": (
        "input tick: Int64\noutput up := down[-1].defaults(to: 4) + tick\noutput down @tick := up[-1].defaults(to: 1) * 3 % 11\n"
        + "\n".join(f'trigger up == {k} "up {k}"' for k in sorted(set(UP))) + "\n" + "\n".join(f'trigger down == {k} "down {k}"' for k in sorted(set(DOWN))),
        TICKS,
        {f"up {k}": [1000 * i for i, x in enumerate(UP) if x == k] for k in set(UP)} | {f"down {k}": [1000 * i for i, x in enumerate(DOWN) if x == k] for k in set(DOWN)},
    ),
    "a_latch_and_a_largest_value": (
        'import math\ninput tick: Int64\noutput top := max(top[-1].defaults(to: 0), tick)\noutput armed := if tick == 3 then true else armed[-1].defaults(to: false)\ntrigger top == 4 "four"\ntrigger !armed "not armed"',
        TICKS, {"four": [1000 * i for i in range(2, 12) if max(7 * j % 5 for j in range(i + 1)) == 4], "not armed": [1000 * i for i in range(12) if all(7 * j % 5 != 3 for j in range(i + 1))]},
    ),
    "recursion_over_a_window": (
        "input drop: Int64\noutput total @1s := total.offset(by: -1).defaults(to: 0) + drop.aggregate(over: 1s, using: sum)\n" 'trigger total > 20 "much"',
        RAIN, {"much": [2000, 3000, 4000, 5000, 6000]},
    ),
    # windows: a second before each deadline, two seconds, or not at all before there are so many
    "counts_in_a_window": (
        "input drop: Int64\noutput n @1s := drop.aggregate(over: 2s, using: count)\n" + "\n".join(f'trigger n == {k} "{k}"' for k in range(6)),
        RAIN, {"0": [0, 5000], "1": [6000], "2": [4000], "3": [1000, 3000], "4": [2000]},
    ),
    "results_of_windows": (
        "input drop: Int64\noutput s @1s := drop.aggregate(over: 2s, using: sum)\noutput a @1s := drop.aggregate(over: 2s, using: avg).defaults(to: -1)\n"
        "output lo @1s := drop.aggregate(over: 2s, using: min).defaults(to: -1)\noutput hi @1s := drop.aggregate(over: 2s, using: max).defaults(to: -1)\n"
        'trigger s == 21 "sum 21"\ntrigger a == 4 "mean 4"\ntrigger a == 5 "mean 5"\ntrigger a == -1 "empty"\ntrigger lo == 2 "least 2"\ntrigger hi == 9 "most 9"',
        RAIN, {"sum 21": [2000], "mean 4": [1000, 4000], "mean 5": [2000, 3000], "empty": [0, 5000], "least 2": [3000, 4000], "most 9": [2000, 3000]},
    ),
    "whole_windows_only": (
        'input drop: Int64\noutput n @1s := drop.aggregate(over_exactly: 2s, using: count).defaults(to: 99)\ntrigger n == 99 "too early"\ntrigger n == 4 "four"',
        RAIN, {"too early": [0, 1000], "four": [2000]},
    ),
    "truth_in_a_window": (
        "input drop: Int64\noutput big := drop > 4\noutput all @1s := big.aggregate(over: 1s, using: forall)\noutput some @1s := big.aggregate(over: 1s, using: exists)\noutput n @1s := big.aggregate(over: 1s, using: sum)\n"
        'trigger all "all"\ntrigger some "some"\ntrigger n == 1 "one"',
        RAIN, {"all": [0, 2000, 4000, 5000], "some": [1000, 2000, 3000], "one": [1000, 2000, 3000]},
    ),
    "the_area_under_values": (
        # between 0.1 and 0.6: 4 * 0.5; 0.6 and 0.7: 4.5 * 0.1; 0.7 and 1.9: 6.5 * 1.2
        'input drop: Float64\noutput area @2s := drop.aggregate(over: 2s, using: integral)\ntrigger area > 10.2 && area < 10.3 "10.25"\ntrigger area == 0.0 "none"',
        RAIN, {"10.25": [2000], "none": [0, 6000]},
    ),
    # types and functions
    "all_types_from_text": (
        'input b: Bool, u: UInt16, i: Int32, f: Float32, s: String\ntrigger !b\ntrigger u > 40000\ntrigger i < -70000\ntrigger f = 0.25\ntrigger s = "a b"',
        "s,f,i,u,b,time\na b,0.25,-70001,40001,false,1700000000.25",
        {"!b": 1, "u > 40000": 1, "i < -70000": 1, "f = 0.25": 1, 's = "a b"': 1},
    ),
    "patterns": (
        'import regex\ninput word: String\noutput x := matches(word, regex: "an{2}")\noutput y := word.matches(regex: "^b.*a$")\ntrigger x "two n"\ntrigger y "b to a"',
        table("word time", "banana 1", "annie 2", "bannana 3", "cabana 4"), {"two n": [2000, 3000], "b to a": [1000, 3000]},
    ),
    "bytes": (
        'import regex\ninput raw: Bytes\noutput second := raw.at(index: 1).defaults(to: 0)\ntrigger second == 111 "an o"\ntrigger second == 0 "too short"\ntrigger raw.matches(regex: "f.o$") "f.o"',
        table("raw time", "foo 1", "x 2", "po 3", "of-o 4"), {"an o": [1000, 3000], "too short": [2000], "f.o": [1000, 4000]},
    ),
    "smaller_and_larger": (
        'import math\ninput gust: Int64\noutput a := min(gust, 7)\noutput b := max(gust - 8, abs(-gust) - 8)\ntrigger a == 7 "capped"\ntrigger b == 1 "one over"\ntrigger sqrt(cast<Int64, Float64>(gust)) == 3.0 "three"',
        WIND, {"capped": [2000, 3000, 5000], "one over": [2000], "three": [2000]},
    ),
}
