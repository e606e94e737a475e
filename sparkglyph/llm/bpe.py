"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is cut as the tokenizer's file says: special strings first, then the
byte-level pattern.  For a piece, one pass through the suffix automaton of the vocabulary
gives the tokens that end at each place, longest first.  Every prefix has exactly one
last token: the one that is compatible with the last token of the prefix before it,
that is, whose pair encodes to itself.  Following these back from the end gives the
very ids of the merge procedure, in time linear in the piece.

Whether a pair is compatible is found by undoing merges at the border, latest
first: the pair is not if some two tokens that touch there would have been merged
before either was taken up into a larger one.

The vocabulary file is read on the driver (its path is a parameter), where the automaton
is built; both are sent to the executors once (their size doesn't depend on the data).  Pieces are encoded once while they stay in a bounded cache.

Defined cases: null is the empty text, with no ids; any length works, as pieces are
joined by document and nothing is cut.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

#: Fixed value: the byte-level pattern, with white space as Unicode's property has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of the caches of pieces (in each of two generations) and of pairs; pieces longer than LONG_PIECE are not kept.
MOST_PIECES, MOST_PAIRS, LONG_PIECE = 200_000, 500_000, 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Suffixes:
    """The suffix automaton of a set of words.

    A state stands for strings that end at the same places of the words; ``size`` is the length of the longest and
    ``link`` the state of its longest suffix that ends at more places.  A word is the longest string of its
    state, so a state has one word at most.  ``nearest`` is the first state with a word on the way along the links, from
    the state itself; ``further`` that from its link.
    """

    def __init__(self, words: Iterable[tuple[bytes, int]]):
        self.step: dict[int, int] = {}
        self.size, self.link, self.word = [0], [-1], [-1]
        self._out = [b""]
        for word, name in words:
            state = 0
            for byte in word:
                state = self._extended(state, byte)
            self.word[state] = name
        del self._out
        self._settle()

    def _state(self, size: int, link: int, like: int = -1) -> int:
        new = len(self.size)
        self.size.append(size)
        self.link.append(link)
        self.word.append(-1)
        self._out.append(self._out[like] if like >= 0 else b"")
        for byte in self._out[new]:
            self.step[new << 8 | byte] = self.step[like << 8 | byte]
        return new

    def _exact(self, state: int, byte: int) -> int:
        """Where a byte leads from a state, as a state whose longest string is no longer than that step."""
        to = self.step[state << 8 | byte]
        if self.size[to] == self.size[state] + 1:
            return to
        part = self._state(self.size[state] + 1, self.link[to], to)
        self.link[to] = part
        while state >= 0 and self.step.get(state << 8 | byte) == to:
            self.step[state << 8 | byte] = part
            state = self.link[state]
        return part

    def _extended(self, last: int, byte: int) -> int:
        if last << 8 | byte in self.step:
            return self._exact(last, byte)
        new = self._state(self.size[last] + 1, 0)
        state = last
        while state >= 0 and state << 8 | byte not in self.step:
            self.step[state << 8 | byte] = new
            self._out[state] += bytes([byte])
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._exact(state, byte)
        return new

    def _settle(self) -> None:
        self.nearest = [0] * len(self.size)
        for state in np.argsort(self.size, kind="stable")[1:].tolist():
            self.nearest[state] = state if self.word[state] >= 0 else self.nearest[self.link[state]]
        self.further = [self.nearest[max(x, 0)] for x in self.link]

    def __getstate__(self):
        n = len(self.step)
        tables = (np.fromiter(self.step.keys(), np.int64, n), np.fromiter(self.step.values(), np.int32, n))
        return (*tables, *[np.array(x, np.int32) for x in (self.size, self.link, self.word)])

    def __setstate__(self, tables):
        keys, to, *more = (x.tolist() for x in tables)
        self.step = dict(zip(keys, to, strict=True))
        self.size, self.link, self.word = more
        self._settle()

    def ending(self, text: bytes) -> Iterator[list[int]]:
        """At each place of a text, the words that end there, longest first."""
        state = held = 0
        for byte in text:
            while state >= 0 and state << 8 | byte not in self.step:
                state = self.link[state]
                held = self.size[state] if state >= 0 else 0
            if state < 0:
                state = 0
            else:
                state, held = self.step[state << 8 | byte], held + 1
            found = self.nearest[state] if held == self.size[state] else self.further[state]
            words = []
            while found:
                words.append(self.word[found])
                found = self.further[found]
            yield words


class Bpe:
    """A byte-level vocabulary with its merges."""

    def __init__(self, spec: str, suffixes: Suffixes | None = None):
        spec = json.loads(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole, pair = vocab[left + right], (vocab[left], vocab[right])
            if whole in self.parts:
                raise ValueError(f"two merges make the token {left + right!r}")
            self.parts[whole], self.rank[whole], self.pair_rank[pair] = pair, k, k
        for c in letters:
            self.rank.setdefault(vocab[c], -1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        size = max(self.bytes_of) + 1
        self.decimal = [str(i) for i in range(size)]
        self.length = np.zeros(size, np.int64)
        for i, x in self.bytes_of.items():
            self.length[i] = len(x)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.suffixes = suffixes or Suffixes((self.bytes_of[i], i) for i in vocab.values() if i in self.rank and self.reached(i))
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def touches(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        until, on_right = float("inf"), False
        while True:
            q = self.pair_rank.get((left, right))
            if q is not None and (q < until or (on_right and q == until)):
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                until, on_right, left = a, False, self.parts[left][1]
            else:
                until, on_right, right = b, True, self.parts[right][0]

    def compatible(self, pair: int, left: int, right: int) -> bool:
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        fits = self.pairs[pair] = self.touches(left, right)
        return fits

    def reached(self, token: int) -> bool:
        """Whether the token's own bytes encode to it: its parts do, and nothing comes before their merge."""
        known = self.whole.get(token)
        if known is None:
            todo = [token]
            while todo:
                t = todo[-1]
                if t not in self.parts:
                    self.whole[t] = True
                elif open_ := [p for p in self.parts[t] if p not in self.whole]:
                    todo.extend(open_)
                    continue
                else:
                    self.whole[t] = all(self.whole[p] for p in self.parts[t]) and self._merges_last(t)
                todo.pop()
            known = self.whole[token]
        return known

    def _merges_last(self, token: int) -> bool:
        """The token's parts stay apart until its own merge."""
        left, right = self.parts[token]
        own = self.pair_rank.pop((left, right))
        try:
            return self.touches(left, right)
        finally:
            self.pair_rank[left, right] = own

    def encode_piece(self, piece: bytes) -> list[int]:
        last: list[int] = [-1] * (len(piece) + 1)
        begin: list[int] = [0] * (len(piece) + 1)
        known, m = self.pairs.get, self.suffixes
        step, size, word, nearest, further = m.step, m.size, m.word, m.nearest, m.further
        end = state = held = 0
        for byte in piece:
            end += 1
            held += 1
            key = state << 8 | byte
            while key not in step:  # ends at the empty string, as every byte is a token
                state = m.link[state]
                held = size[state] + 1
                key = state << 8 | byte
            state = step[key]
            found = nearest[state] if held == size[state] else further[state]
            while found:
                token, at = word[found], end - size[found]
                if at:
                    pair = last[at] << 32 | token
                    fits = known(pair)
                    if fits is None:
                        fits = self.compatible(pair, last[at], token)
                    if not fits:
                        found = further[found]
                        continue
                last[end], begin[end] = token, at
                break
        out = []
        at = len(piece)
        while at:
            out.append(last[at])
            at = begin[at]
        out.reverse()
        return out

    def spell(self, piece: str) -> str:
        """The ids of a piece in decimal, joined by commas; recent pieces are kept."""
        made = self.old.get(piece) or ",".join(map(self.decimal.__getitem__, self.encode_piece(piece.encode())))
        if len(piece) <= LONG_PIECE:
            if len(self.young) >= MOST_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = made
        return made

    def spelled(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        out = []
        spell = self.spell
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append(str(self.special[part]))
            elif part:
                known = self.young.get
                out += [known(p) or spell(p) for p in self.pattern.findall(part)]
        return ",".join(out)

    @staticmethod
    def ids(spelled: str) -> np.ndarray:
        return np.fromstring(spelled, np.int64, sep=",") if spelled else np.zeros(0, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.ids(self.spelled(text)).tolist()

    def decode(self, ids) -> str:
        """The text of the ids: their bytes in a row, read as UTF-8."""
        ids = np.asarray(ids, np.int64)
        length = self.length[ids]
        shift = self.begin[ids] - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(ids) else length
        return self.blob[np.repeat(shift, length) + np.arange(int(length.sum()))].tobytes().decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of what they decode to."""
        spelled = self.spelled(text)
        ids = self.ids(spelled)
        return len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_BUILT: dict[int, Bpe] = {}


class Tokenizer:
    """A vocabulary file held by the session; columns are encoded and decoded with it."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            spec = file.read()
        self.spec, self.key = spark.sparkContext.broadcast((spec, Bpe(spec).suffixes)), hash(spec)

    def _maker(self):
        spec, key = self.spec, self.key

        def bpe() -> Bpe:
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = Bpe(*spec.value)
            return _BUILT[key]

        return bpe

    def encode(self, text: Column) -> Column:
        bpe = self._maker()

        @arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            encode = bpe().encode
            return pa.array([encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

        return ids(text)

    def decode(self, ids: Column) -> Column:
        bpe = self._maker()

        @arrow_udf("string")
        def text(lists: pa.Array) -> pa.Array:
            decode = bpe().decode
            return pa.array([decode(x.as_py() or ()) for x in lists], pa.string())

        return text(ids)

    def digest(self, text: Column) -> Column:
        bpe = self._maker()

        @arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
        def of(texts: pa.Array) -> pa.Array:
            digest = bpe().digest
            n, ids, back = zip(*[digest(t.as_py() or "") for t in texts], strict=True) if len(texts) else ((), (), ())
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

        return of(text)
