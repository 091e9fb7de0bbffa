"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger row keeps what was measured and one
bit for each rule that failed. A policy is a versioned choice of bits, so a change of policy, or
the question what a rule alone removes, is bit arithmetic on the ledger and never a second pass
over the text.

Defined results: a null or empty text has no words, so it measures 0 everywhere and fails
``few_words``; very long texts are measured whole; repeated rows and equal identifiers give equal
ledger rows, one each; an empty table gives an empty ledger; columns of the input other than the
identifier and the text are neither read nor returned; a null identifier stays null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from streamspec.llm.common import map_rows, texts_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where its SQL condition over the measurements holds."""

    name: str
    fails: str


#: Bit i of a ledger row belongs to RULES[i]. Rules are only ever appended, so old ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("shouting", "n_letters >= 20 AND 100 * n_upper > 50 * n_letters"),
    Rule("few_letters", "word_chars > 0 AND 100 * n_letters < 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        at = {r.name: i for i, r in enumerate(RULES)}
        return sum(1 << at[name] for name in self.rules)


#: The rules that every policy contains.
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES: dict[str, Policy] = {
    p.version: p
    for p in (
        BASE,
        Policy("2024-strict", tuple(r.name for r in RULES)),
        Policy("2024-default", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "few_letters")),
    )
}
DEFAULT = POLICIES["2024-default"]

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of a[i] and b[i]; equal pairs get equal numbers."""
    k = min(len(a), len(b))
    return np.unique(a[:k] * (int(b.max(initial=0)) + 1) + b[:k], return_inverse=True)[1]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which occurs twice or more, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    name, width, power, step, left = None, 0, ids, 1, window
    while left:  # name[i] stands for the words from i to i + width, exactly; power for step words
        if left & 1:
            name, width = (power, step) if name is None else (_joined(name, power[width:]), width + step)
        left >>= 1
        if left:
            power, step = _joined(power, power[step:]), step * 2
    twice = np.bincount(name)[name] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.encode().split()  # bytes split at ASCII white space alone
    lines = [x for x in text.split("\n") if x and x.encode().split()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(len, _LETTERS.findall(text))),
        len(_UPPER.findall(text)),
    )


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifier and MEASURES of each row."""

    def make():
        def fn(batch):
            rows = [measure(t) for t in texts_of(batch.column(1))]
            cols = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
            return {id_col: batch.column(0)} | dict(zip(MEASURES, map(list, cols), strict=True))

        return fn

    src = docs.select(F.col(id_col), F.col(text_col))
    kind = src.schema[id_col].dataType.simpleString()
    return map_rows(src, make, f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def failures() -> Column:
    """The bits of the rules that failed, of columns of MEASURES."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and fail_bits, the bits of the rules that failed."""
    return measurements(docs, id_col, text_col).withColumn("fail_bits", failures())


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone, and failing if it were dropped.

    The ledger is first counted by masked bits, at most two to the power of the number of rules
    groups, so only those counts are shuffled.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    counts = rows.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    names = [(i, r.name) for i, r in enumerate(RULES) if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in names]))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) != 0
    return (
        counts.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(has & ~rest, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("n_failed_without"),
        )
    )


def judged(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with base_failed and kept, the verdict of the policy."""
    return ledger(docs).withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy)})


def keep_clean(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The documents whose ledger passes, with their own columns. A row goes through the ledger as one
    struct beside its measurements, so names cannot clash, nothing is shuffled and repeated
    identifiers cannot mix."""

    def make():
        def fn(batch):
            rows = [measure(t) for t in texts_of(batch.column("text"))]
            cols = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
            return {"row": pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)} | dict(zip(MEASURES, map(list, cols), strict=True))

        return fn

    schema = StructType([StructField("row", docs.schema), *(StructField(m, LongType()) for m in MEASURES)])
    return map_rows(docs, make, schema).withColumn("fail_bits", failures()).where(passes(BASE) & passes(policy)).select("row.*")
