"""Byte-level BPE vocabularies from files. Nothing is trained here; files are read where they are."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from array import array
from collections.abc import Callable

import regex
import tiktoken
import tokenizers


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, once in each process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Characters that a tokenizer is given at once, about, since its results take many times their room.
PART = 1 << 20
#: A space between two characters that are not white space, at which a match of the pattern always
#: begins and which no special token holds.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int = PART) -> list[str]:
    """A text in parts whose ids, one after another, are those of the text."""
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


#: Stand-ins for the classes of characters: letters, numbers, all others, white space. No pattern
#: tells them from others of their classes in the places where they are put.
_STAND_INS = "a0!\t"
_CLASSES = (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")


class Classes:
    """The classes that a library gives characters, by asking it: its Unicode data are its own.

    together tells whether two characters are one match of the library's pattern.
    """

    def __init__(self, together: Callable[[str], bool]):
        self._together = together
        self._seen: set[str] = set()
        #: For characters that the regex module classes otherwise: the stand-in of their class.
        self.other: dict[int, str] = {}

    def of(self, char: str) -> str:
        """The stand-in of the class of a character."""
        return next((c for c in "a0!" if self._together(c + char)), "\t")

    def learn(self, chars: set[str]) -> None:
        for c in chars - self._seen:
            told = self.of(c)
            if not regex.match(_CLASSES[_STAND_INS.index(told)], c):
                self.other[ord(c)] = told
        self._seen |= chars


def _splitter(pattern: str, together: Callable[[str], bool]) -> Callable[[str], list[str]]:
    """The matches of a pattern of letters, numbers, white space and single characters, as a library
    finds them. Texts of the first 256 code points, which are most, are split by the standard
    library, twice as fast, with the classes written out; others by the regex module, in which
    characters that it classes otherwise than the library give way to stand-ins."""
    general, classes = regex.compile(pattern), Classes(together)
    own: dict[str, str] = dict.fromkeys(_STAND_INS, "")
    for c in map(chr, range(256)):
        own[classes.of(c)] += re.escape(c)
    narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[{own['!']}]").replace(r"\p{L}", f"[{own['a']}]").replace(r"\p{N}", f"[{own['0']}]")
    narrow = narrow.replace(r"\s", f"[{own['\t']}]").replace(r"\S", f"[^{own['\t']}]")
    if r"\p" in narrow:
        raise ValueError("patterns may only tell letters, numbers and white space")
    latin = re.compile(narrow).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            chars = set(text)
            classes.learn(chars)
            if any(ord(c) in classes.other for c in chars):
                return [text[m.start() : m.end()] for m in general.finditer(text.translate(classes.other))]
            return general.findall(text)
        return latin(text)

    return split


@functools.lru_cache(maxsize=2)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Splits texts as tiktoken does. Pairs of a stand-in and any byte are tokens of an encoding of its
    own, so that the first token tells whether two characters are together."""
    ranks = {bytes([i]): i for i in range(256)}
    for c in b"a0!":
        ranks |= {bytes([c, i]): len(ranks) + i for i in range(256)}
    own = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
    return _splitter(pattern, lambda pair: own.encode_ordinary(pair)[0] >= 256)


def _alphabet() -> dict[int, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of the first 256 code
    points are themselves, the others those from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}


#: Fixed value: the pattern of the byte-level pre-tokenizer, which its files do not name.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """The ids of texts by a tokenizer, as the library gives them.

    Byte-level tokenizers encode each match of their pattern by itself, so the library is asked once
    for each distinct match (the first `most` are remembered) and the ids of a text are put together.
    Texts that hold an added token, and those of tokenizers of any other kind, are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = False, most: int = 300_000):
        self.own = tokenizers.Tokenizer.from_file(path)
        self.own.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told["pre_tokenizer"] or {}
        self.by_match = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not told["normalizer"] and not told["model"].get("dropout")
        self.added = [t["content"] for t in told["added_tokens"] if not (t["special"] and special_as_text)]
        self.most, self.known = most, {}
        self.model, self.letters = self.own.model, _alphabet()
        if self.by_match:
            self.split = _splitter(BYTE_LEVEL, lambda pair: len(self.own.pre_tokenizer.pre_tokenize_str(pair)) == 1)

    def _match(self, word: str) -> bytes:
        """The ids of one match of the pattern."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each, without special tokens around them."""
        if not self.by_match or any(t in text for t in self.added):
            return b"".join(array("I", self.own.encode(p, add_special_tokens=False).ids).tobytes() for p in parts(text))
        own, known = self.split(text), self.known
        try:
            return b"".join(map(known.__getitem__, own))
        except KeyError:
            new = list(set(own).difference(known))
            more = {w: self._match(w) for w in new}
            if len(known) + len(more) <= self.most:
                known |= more
                return b"".join(map(known.__getitem__, own))
            return b"".join([known[w] if w in known else more[w] for w in own])


@functools.lru_cache(maxsize=2)
def text_ids(path: str, special_as_text: bool = False) -> TextIds:
    """Once in each process. The library uses the thread that calls it alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextIds(path, special_as_text)
