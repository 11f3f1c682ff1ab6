"""BPE encoding and decoding by a tokenization automaton (operator 5).

The merge list is compiled into a deterministic automaton whose arcs carry
tokens and whose paths are exactly the correct BPE token sequences. It starts
as one state with an arc for every byte. The gadget of merge (u, v) -> uv
takes the state q that u's arcs lead to: u's arcs are led to a copy of q
without the v arc (u must not be followed by v any more), and every state
with a u arc gets a uv arc to where v leads from q. All arcs with one label
lead to one state, so a merge adds at most one state.

A state keeps the labels taken from it and the merge that took them; an arc
for uv exists where u existed when uv was made. So ``arc(state, token)`` walks
the token's left parts, a few table look-ups.

Every prefix of a word has exactly one correct token sequence, so one state at
most can be at a byte position: encoding follows the arcs that match the next
bytes and visits each position once at most; decoding emits the arcs' labels.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

# FIXED: the pre-split pattern of byte-level BPE.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# FIXED: letters and digits that the regex module's newer Unicode version has
# and the tokenizer's doesn't; there they count as neither.
NEWER = ("558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
         "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
         "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
         "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
         "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")
WORDS_KEPT = 300_000        # words, and stretches between spaces, that a worker remembers before it starts anew
STEPS_KEPT = 300_000      # transitions a worker keeps computed
LONG_TEXT = 4_000_000       # texts from this length are split lazily


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        alphabet = byte_alphabet()
        self.label = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.target: dict[int, int] = {}
        self.taken: list[dict[int, int]] = [{}]
        self.states = 1
        for token, i in vocab.items():
            if len(token) == 1 and token in alphabet:
                self.target[i] = 0
        self._users = [len(self.target) + 1]    # arcs into a state by label; the start counts too
        for step, (u, v) in enumerate(merges):
            self._gadget(step, vocab[u], vocab[v], vocab[u + v])
        self._tables()

    def _gadget(self, step: int, u: int, v: int, uv: int) -> None:
        if u not in self.target or v not in self.target:
            if not self._dead(u) and not self._dead(v):
                raise ValueError(f"merge {step} uses a token that no earlier merge makes")
            self.left[uv], self.born[uv] = -1, step
            return
        if uv in self.target:
            raise ValueError(f"merge {step} makes a token a second time")
        q = self.target[u]
        if not self.arc(q, v):          # u and v never meet: the token can't occur
            self.left[uv], self.born[uv] = -1, step
            return
        self.left[uv], self.born[uv] = u, step
        self.target[uv] = self.target[v]
        self._users[self.target[v]] += 1
        if self._users[q] > 1:
            self._users[q] -= 1
            self.taken.append(dict(self.taken[q]))
            self._users.append(1)
            self.target[u] = q = self.states
            self.states += 1
        self.taken[q][v] = step

    def _dead(self, token: int) -> bool:
        return self.left.get(token) == -1

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        taken, later, left, born = self.taken[state], None, self.left, self.born
        while True:
            step = taken.get(token)
            if step is not None and (later is None or step <= later):
                return False
            below = left.get(token)
            if below is None:
                return True
            if below == -1:
                return False
            later, token = born[token], below

    def _tables(self) -> None:
        """Arcs by label, the longest label by its first two bytes, and the
        transitions found so far."""
        self.by_label = {self.label[t]: t for t in self.target}
        self.reach: dict[bytes, int] = {}
        for label in self.by_label:
            self.reach[label[:2]] = max(len(label), self.reach.get(label[:2], 1))
        self.step: dict[int, int] = {}

    def _step(self, state: int, token: int) -> int:
        """The transition table, filled as it is used: the next state, or -1."""
        if len(self.step) >= STEPS_KEPT:
            self.step.clear()
        to = self.step[state << 20 | token] = self.target[token] if self.arc(state, token) else -1
        return to

    def encode(self, word: bytes) -> list[int]:
        """The token ids of one pre-split word: the path whose labels spell it.
        From each place the longest arc is tried first; a place that turned out
        a dead end is never entered again, since only one state can be there."""
        n, by_label, reach, step = len(word), self.by_label, self.reach, self.step
        path: list[int] = []
        frames: list[tuple[int, int, int]] = []
        dead: set[int] = set()
        i = state = 0
        j = min(n, reach.get(word[:2], 1))
        while i < n:
            while j > i:
                token = by_label.get(word[i:j])
                if token is not None and j not in dead:
                    to = step.get(state << 20 | token)
                    if to is None:
                        to = self._step(state, token)
                    if to >= 0:
                        break
                j -= 1
            else:
                dead.add(i)
                if not frames:
                    raise ValueError("the vocabulary lacks a byte of this text")
                i, state, j = frames.pop()
                path.pop()
                j -= 1
                continue
            frames.append((i, state, j))
            path.append(token)
            i, state = j, to
            j = min(n, i + reach.get(word[i:i + 2], 1))
        return path

    def decode(self, ids) -> bytes:
        """The labels along the path."""
        return b"".join(map(self.label.__getitem__, ids))


class Tokenizer:
    """A byte-level BPE tokenizer file: added tokens, pre-split, automaton."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or d["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        if any(t[k] for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.words = regex.compile(PRE_SPLIT)
        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
        self.newer = regex.compile(f"[{newer}]")
        letter, digit = (rf"[\p{{{c}}}--[{newer}]]" for c in "LN")
        self.exact_words = regex.compile(PRE_SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letter}{digit}]").replace(r" ?\p{L}", f" ?{letter}").replace(r" ?\p{N}", f" ?{digit}"), regex.V1)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.bytes_of = {str(i): b for i, b in self.automaton.label.items()} | {str(i): t.encode() for t, i in self.added.items()}
        self.seen: dict[str, str] = {}          # words
        self.after_space: dict[str, str] = {}   # what stands between two spaces

    def _word(self, word: str) -> str:
        if len(self.seen) >= WORDS_KEPT:
            self.seen.clear()
        ids = ",".join(map(str, self.automaton.encode(word.encode())))
        if len(word) <= 64 and (word.isascii() or not self.newer.search(word)):
            self.seen[word] = ids
        return ids

    def _ids(self, words: list[str]) -> list[str]:
        return [self.seen.get(w) or self._word(w) for w in words]

    def _spaced(self, piece: str) -> list[str] | None:
        """The ids of a piece, cut before spaces. A space before a character that
        isn't white space always starts a pre-split word, so what follows it up to
        the next such space is split and encoded on its own, once per distinct
        string. None where a space has another neighbour."""
        head, *rest = piece.split(" ")
        got = list(map(self.after_space.get, rest))
        for i in [i for i, g in enumerate(got) if g is None] if None in got else []:
            w = rest[i]
            if not w or w[0].isspace() or (not w.isascii() and self.newer.search(w)):
                return None
            ids = self.after_space.get(w)
            if ids is None:
                ids = ",".join(self._ids(self.words.findall(" " + w)))
                if len(self.after_space) >= WORDS_KEPT:
                    self.after_space.clear()
                if len(w) <= 64:
                    self.after_space[w] = ids
            got[i] = ids
        if not head:
            return got
        if not head.isascii() and self.newer.search(head):
            return None
        return [*self._ids(self.words.findall(head)), *got]

    def parts(self, text: str) -> Iterator[str]:
        """Comma-joined decimal ids, a bounded piece of the text at a time."""
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.added:
                yield str(self.added[piece])
                continue
            if not piece:
                continue
            if len(piece) < LONG_TEXT:
                got = self._spaced(piece)
                if got is None:
                    got = self._ids((self.exact_words if self.newer.search(piece) else self.words).findall(piece))
                yield ",".join(got)
                continue
            pattern = self.exact_words if self.newer.search(piece) else self.words
            found = (m.group() for m in pattern.finditer(piece))
            while words := list(islice(found, 100_000)):
                yield ",".join(self._ids(words))

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.parts(text) for i in part.split(",")]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[str(i)] for i in ids).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the joined ids, digest of the decoded text.
        The ids are decoded again from their joined form."""
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        open_bytes = b""
        for part in self.parts(text):
            tokens = part.split(",")
            ids.update((("," if n else "") + part).encode())
            n += len(tokens)
            open_bytes += b"".join(map(self.bytes_of.__getitem__, tokens))
            # keep an unfinished character for the next part
            cut = len(open_bytes)
            for k in range(1, min(4, cut) + 1):
                if open_bytes[cut - k] >= 0xC0:
                    cut -= k
                    break
                if open_bytes[cut - k] < 0x80:
                    break
            back.update(open_bytes[:cut].decode("utf-8", "replace").encode())
            open_bytes = open_bytes[cut:]
        back.update(open_bytes.decode("utf-8", "replace").encode())
        return n, ids.hexdigest(), back.hexdigest()


_loaded: dict[str, Tokenizer] = {}


def loaded(spec: str) -> Tokenizer:
    """One compiled automaton per worker process and tokenizer file."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(spec)
    return _loaded[key]


def _spec(df: DataFrame, path: str):
    """The tokenizer file (a few MB whatever the corpus) as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in an array column.

    A null text counts as empty and an empty text gives an empty array; rows
    stay as they are, repeated ones included; a column already called ``out``
    is replaced; an empty table stays empty.
    """
    spec = _spec(docs, path)
    keep = [c for c in docs.columns if c != out]
    schema = docs.select(*keep, F.array(F.lit(0)).alias(out)).schema

    def run(batches):
        tokenizer = loaded(spec.value)
        for b in batches:
            ids = [tokenizer.encode(t.decode()) for t in texts_of(b.column(text))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, out])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text its id arrays stand for; a null array gives null."""
    spec = _spec(tokens, path)
    keep = [c for c in tokens.columns if c != out]
    schema = tokens.select(*keep, F.lit("").alias(out)).schema

    def run(batches):
        tokenizer = loaded(spec.value)
        for b in batches:
            back = [None if x is None else tokenizer.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(back, pa.string())], [*keep, out])

    return tokens.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text:
    encoded, the ids decoded again, both digested piece by piece so that no
    id list of a long text is held. One row per row; null text counts as
    empty; a null doc_id stays null."""
    spec = _spec(docs, path)

    def run(batches):
        tokenizer = loaded(spec.value)
        for b in batches:
            got = [tokenizer.digests(t.decode()) for t in texts_of(b.column(1))]
            n, ids, back = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
