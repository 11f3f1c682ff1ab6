"""License scan: Aho-Corasick over words, and a shunting-yard parser for licence
expressions (operator 2).

All notice phrases and identifier tags sit in one Aho-Corasick automaton whose
alphabet is words, so every text is read once, whatever the number of phrases.
The text behind an identifier tag, up to the end of its line, is a licence
expression: a shunting-yard parser turns it into postfix order (WITH binds
tightest, then AND, then OR) and evaluates it to its licence families and a
score of how freely the text may be used: OR takes the better side (the user
chooses), AND the worse, WITH adds permissions to its left side. An operand is an
identifier of a listed family, a LicenseRef- or a DocumentRef-, or behind WITH an
exception; the expression ends before any other word, and behind an operand that
a full stop or colon follows. At most EXPRESSION bytes behind a tag are parsed.
"""
from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, texts_of

# FIXED: the base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
}
TAGS = ("spdx license identifier", "license expression")
#: how freely a family's texts may be used
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3,
    "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0,
}
#: identifiers of other families: their scores
FREEDOM |= {"0bsd": 1.0, "zlib": 1.0, "x11": 1.0, "ncsa": 1.0, "postgresql": 1.0, "python": 1.0, "psf": 1.0, "wtfpl": 1.0, "artistic": 0.6, "afl": 0.9,
            "cddl": 0.6, "cpl": 0.6, "eupl": 0.4, "ms-pl": 0.6, "ofl": 0.6, "openssl": 0.9, "osl": 0.3, "sspl": 0.1, "busl": 0.1, "gfdl": 0.3, "cecill": 0.3}
EXPRESSION = 1000   # bytes behind a tag that are read
UNKNOWN = 0.5       # no notice at all, or a licence that isn't listed
PIECE = 4 << 20     # bytes of a text whose words are held at once


class AhoCorasick:
    """Finds phrases (word sequences) in a stream of words."""

    def __init__(self, phrases: Iterable[str]):
        self.go: list[dict[bytes, int]] = [{}]
        self.out: list[list[tuple[str, int]]] = [[]]
        for p in phrases:
            node, words = 0, p.encode().split()
            for w in words:
                if w not in self.go[node]:
                    self.go[node][w] = len(self.go)
                    self.go.append({})
                    self.out.append([])
                node = self.go[node][w]
            self.out[node].append((p, len(words)))
        self.fail = [0] * len(self.go)
        queue = deque(self.go[0].values())
        while queue:
            node = queue.popleft()
            for w, child in self.go[node].items():
                f = self.fail[node]
                while f and w not in self.go[f]:
                    f = self.fail[f]
                self.fail[child] = self.go[f].get(w, 0)
                self.out[child] += self.out[self.fail[child]]
                queue.append(child)
        self.words = frozenset(w for g in self.go for w in g)

    def find(self, pieces: Iterable[list[bytes]]) -> Iterator[tuple[str, int]]:
        """(phrase, number of its first word) of every place, ends in order."""
        state, before, last = 0, 0, -2
        for words in pieces:
            if not self.words.isdisjoint(words):
                known = self.words
                for i in [i for i, w in enumerate(words) if w in known]:
                    w, at = words[i], before + i
                    if at != last + 1:      # a word that no phrase has lies between
                        state = 0
                    last = at
                    while state and w not in self.go[state]:
                        state = self.fail[state]
                    state = self.go[state].get(w, 0)
                    for p, n in self.out[state]:
                        yield p, at - n + 1
            before += len(words)


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``size`` bytes at a time."""
    plain, a = text.translate(WORD_TABLE), 0
    while a < len(plain):
        b = a + size
        if b < len(plain):
            cut = plain.rfind(b" ", a, b)
            b = cut if cut > a else plain.find(b" ", b)
        b = len(plain) if b < 0 else b
        yield plain[a:b].split()
        a = b


# ---- licence expressions -------------------------------------------------
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def tokens_of(text: str) -> list[str]:
    """The tokens at the start of ``text``, as far as it looks like an expression."""
    out, at, operand = [], 0, False
    while m := _TOKEN.match(text, at):
        t = m[1]
        up = t.upper()
        if up in _BINDS or t == ")":
            if not operand:
                break
            operand = t == ")"
        elif operand:                  # two operands in a row: prose follows
            break
        elif t == "(":
            operand = False
        else:
            name = t.rstrip(".:")
            if not (_exception(name) if out and out[-1] == "WITH" else _identifier(name)):
                break
            operand = True
            if name != t:
                out.append(name)
                break
        out.append(up if up in _BINDS else t)
        at = m.end()
    return out


def _identifier(name: str) -> bool:
    return name.lower().startswith(("licenseref-", "documentref-")) or family(name) in FREEDOM


def _exception(name: str) -> bool:
    return "exception" in name.lower()


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard; an unfinished end is closed, a stray ) is passed over."""
    while tokens and (tokens[-1] in _BINDS or tokens[-1] == "("):
        tokens = tokens[:-1]
    out: list[str] = []
    stack: list[str] = []
    for t in tokens:
        if t in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        else:
            out.append(t)
    return out + [t for t in reversed(stack) if t != "("]


def family(identifier: str) -> str:
    """The family of a licence identifier: its longest listed beginning."""
    name = identifier.lower().rstrip("+")
    listed = [f for f in FREEDOM if name == f or name.startswith(f + "-")]
    if name.startswith("cc0") or name == "unlicense":
        return "public-domain"
    return max(listed, key=len) if listed else name


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Families and score of an expression; None if it holds no licence."""
    stack: list[tuple[set[str], float]] = []
    order = postfix(tokens_of(expression))
    for t in order:
        if t not in _BINDS:
            stack.append(({family(t)}, FREEDOM.get(family(t), UNKNOWN)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if t == "WITH":
            stack.append((left, min(1.0, a + 0.2)))
        else:
            stack.append((left | right, max(a, b) if t == "OR" else min(a, b)))
    return stack[-1] if stack else None


# ---- documents -------------------------------------------------------------
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def scan(text: bytes, automaton: AhoCorasick):
    """n_words, base places, their first and last word, base labels, labels,
    expressions, score."""
    n, tags, places, labels, base = 0, [], [], set(), set()

    def counted():
        nonlocal n
        for words in word_pieces(text):
            n += len(words)
            yield words

    for p, at in automaton.find(counted()):
        if p in BASE_PHRASES:
            places.append(at)
            base.add(BASE_PHRASES[p])
        elif p in NOTICES:
            labels.add(NOTICES[p])
        else:
            tags.append(at + p.count(" "))
    labels |= base
    scores = [FREEDOM[x] for x in labels]
    found = []
    if tags:
        ends, want = [], set(tags)
        for i, m in enumerate(_WORD.finditer(text)):
            if i in want:
                ends.append(m.end())
        for e in ends:
            stop = text.find(b"\n", e, e + EXPRESSION)
            line = text[e:min(stop if stop >= 0 else len(text), e + EXPRESSION)]
            expression = line.decode("utf-8", "replace").lstrip(" \t:=\"'")
            got = evaluate(expression)
            if got:
                found.append(" ".join(tokens_of(expression)))
                labels |= got[0]
                scores.append(got[1])
    return (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), found, min(scores, default=UNKNOWN))


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double"
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.float64()]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    expressions, score; one row per row of ``docs``.

    Base columns count the places of BASE_PHRASES (places may overlap; word
    numbers from 0, null without a place). ``labels`` adds NOTICES and the
    families in the expressions behind TAGS; both label columns are distinct,
    sorted and comma-joined, empty without a label. ``score`` is the smallest
    of the labels' and expressions' scores, 0.5 if there is none. A null text
    counts as empty; a null doc_id stays null; an empty table stays empty.
    """
    def run(batches):
        automaton = AhoCorasick([*BASE_PHRASES, *NOTICES, *TAGS])
        for b in batches:
            rows = [scan(t, automaton) for t in texts_of(b.column(1))]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], [f.split()[0] for f in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)
