"""Personal data found by expanding anchors.

One Aho-Corasick pass over a text finds the anchors: at-signs, address schemes and words that
announce an identifier. From each anchor a small deterministic parser walks to the boundaries of
the email, the address or the account and validates what it found. Digit runs and plus signs are
their own anchors: the regular expressions of the base kinds start at them.

Base kinds (email, ip, card, phone) follow the contract of the query: leftmost matches that do
not overlap within a kind, and a match that fails its check is dropped without a second try. The
further kinds (url, account, secret) only add spans.

Defined results: a null or empty text has no spans; very long texts are searched whole, in linear
time; equal rows give equal rows; an empty table gives an empty one; further columns are kept
by ``masked`` and neither read nor returned by ``found``; a null identifier stays null. Masked
null texts stay null.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamspec.llm.common import map_rows, texts_of

Span = tuple[str, int, int]
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

#: Anchors by the parser that expands them. Letters are matched in either case.
AT_SIGNS = ("@",)
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
ACCOUNT_CUES = ("iban", "account number", "account no", "acct", "kontonummer", "ssn", "passport no", "passport number", "tax id")
SECRET_CUES = ("password", "passwd", "token", "api_key", "api key", "apikey", "secret_key", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits that an earlier place of the run could not begin, so
# the lookbehind changes no match; it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"(?:[^\s/?#@<>\"']{1,256}@)?(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_GAP = re.compile(r"[ \t]*(?:[:=#]|is\b)[ \t]*[\"']?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){2,8}")
_NUMBER = re.compile(r"[A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,19}")
_SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{8,}")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether the check digits of an account number in the international form are right."""
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def automaton() -> ahocorasick.Automaton:
    """All anchors in one automaton, for ASCII lower case text."""
    a = ahocorasick.Automaton()
    for parser, words in (("at", AT_SIGNS), ("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            a.add_word(w, (parser, len(w)))
    a.make_automaton()
    return a


def _word_before(text: str, at: int) -> bool:
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text by start, then kind, then end; ends are exclusive, in code points."""
    out: list[Span] = []
    free = {"email": 0, "url": 0, "account": 0, "secret": 0}  # where the last span of the kind ended
    lowered = text.encode().lower().decode()  # ASCII alone, so that places stay the same
    for last, (parser, n) in anchors.iter(lowered):
        start, end = last - n + 1, last + 1
        if parser == "at":
            left = start
            while left > free["email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, end)):
                out.append(("email", left, m.end()))
                free["email"] = m.end()
        elif parser == "url":
            if start >= free["url"] and not _word_before(text, start) and (m := _HOST.match(text, end)):
                stop = m.end()
                while text[stop - 1] in ".,;:!?)]":
                    stop -= 1
                if stop > end:
                    out.append(("url", start, stop))
                    free["url"] = stop
        elif not _word_before(text, start) and (gap := _GAP.match(text, end)):
            at = gap.end()
            if parser == "account" and at >= free["account"]:
                m = _IBAN.match(text, at)
                if m and not iban(m[0]):
                    m = None
                if m or (m := _NUMBER.match(text, at)):
                    out.append(("account", at, m.end()))
                    free["account"] = m.end()
            elif parser == "secret" and at >= free["secret"] and (m := _SECRET.match(text, at)) and re.search(r"[0-9]", m[0]):
                out.append(("secret", at, m.end()))
                free["secret"] = m.end()
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], _ORDER[s[0]], s[2]))
    return out


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def mask(text: str, found: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    parts, at, i = [], 0, 0
    while i < len(found):
        kind, start, end = found[i]
        i += 1
        while i < len(found) and found[i][1] < end:
            end = max(end, found[i][2])
            i += 1
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*parts, text[at:]])


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifier and spans, an array of kind, start and end, of every row."""

    def make():
        a = automaton()

        def fn(batch):
            hits = [spans(t, a) for t in texts_of(batch.column(1))]
            return {
                id_col: batch.column(0),
                **{f"n_{k}": [sum(s[0] == k for s in h) for h in hits] for k in KINDS},
                "base_sha256": [hashlib.sha256(written([s for s in h if s[0] in BASE_KINDS]).encode()).hexdigest() for h in hits],
                "spans": [written(h) for h in hits],
            }

        return fn

    src = docs.select(F.col(id_col), F.col(text_col))
    kind = src.schema[id_col].dataType.simpleString()
    return map_rows(src, make, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data replaced by the names of the kinds; length_col, if there, follows the text."""
    names = docs.columns

    def make():
        a = automaton()

        def fn(batch):
            texts = [None if t is None else mask(t, spans(t, a)) for t in batch.column(text_col).to_pylist()]
            cols = {n: batch.column(n) for n in names} | {text_col: texts}
            if length_col in names:
                old = batch.column(length_col).to_pylist()
                cols[length_col] = [o if t is None else len(t) for t, o in zip(texts, old, strict=True)]
            return cols

        return fn

    return map_rows(docs, make, docs.schema)
