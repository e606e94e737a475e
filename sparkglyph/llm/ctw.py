"""Scoring by context-tree weighting over bytes, and by a word unigram base.

Each byte is eight binary decisions; a decision's node is named by the bits before
it in the byte and by a context of 0 to ``DEPTH`` bytes before.  Every node has a
Krichevsky-Trofimov estimate of its counts, and mixes it with what its children, one
byte deeper, say; the weights are the posterior ones after the training text, so a
prediction is the mixture over all depths.  An unseen child predicts one half.  The
text ends in a byte that UTF-8 doesn't have, which is coded too, so the probabilities
of all texts sum to at most 1.

Counts of byte strings and of words come from all training documents, summed within
each task before they are shuffled.  Both grow with the corpus without bound.  A
tree of up to ``MOST_GRAMS`` strings is built on the driver and sent whole.  A larger one
of the same depth stays distributed: all strings with the same two bytes before the coded
one are in one task, which grows their part of the tree; the nodes of shorter contexts are
made on the driver from the parts' sums.  The probabilities of the ``MOST_GRAMS`` most
frequent strings are sent to the executors, those of all others, seen or not, are joined
by a shuffle.  So are words beyond the ``MOST_WORDS`` most frequent ones.

Defined cases: null is the empty text, which still has its end; a null id counts as
training; without training documents all counts are 0; repeated rows are scored and
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import staging
from . import bytesops as B
from .text import remainder

DEPTH = 4
MOST_GRAMS, MOST_WORDS = 1_000_000, 500_000
#: Distinct strings and words that a task gathers before it passes them on.
GATHER = 600_000
#: Bytes of context by which a distributed tree is dealt out; strings, about, of one of its tasks.
SHARED, PART = 2, 250_000
END = 0xFF
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ONE = np.uint64(1)
_log: list[np.ndarray] = []


def log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log Gamma(n + 1/2) or log Gamma(n + 1) of whole numbers: sums of logarithms, and Stirling's series beyond."""
    if not _log:
        k = np.arange(1 << 16)
        _log.extend(np.concatenate([[z], z + np.cumsum(np.log(k + (0.5 if h else 1.0)))]) for h, z in ((False, 0.0), (True, 0.5 * math.log(math.pi))))
    table = _log[int(half)]
    x = n + (0.5 if half else 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], series)


class Index:
    """Sorted 64-bit keys with a first look-up by the leading bits of a mixed key."""

    def __init__(self, keys: np.ndarray):
        mixed = B.mixed(keys)
        self.order = np.argsort(mixed)
        self.mixed = np.append(mixed[self.order], np.uint64(2**64 - 1))
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.mixed[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.size = len(keys)

    def sort(self, values: np.ndarray) -> np.ndarray:
        """Values in the order of the keys as given, put in that of the index; one more stands at the end for keys not found."""
        return np.append(values[self.order], values.dtype.type(1))

    def __getstate__(self):  # the order is only needed while the values are put in place
        return {k: v for k, v in self.__dict__.items() if k != "order"}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places among the sorted keys, or -1."""
        if not self.size:
            return np.full(len(keys), -1)
        h = B.mixed(keys)
        at = self.first[h >> self.shift]
        key = self.mixed[at]
        out = np.where(key == h, at, -1)
        open_ = np.flatnonzero(key < h)
        at = at[open_] + 1
        while len(open_):
            key = self.mixed[at]
            hit = key == h[open_]
            out[open_[hit]] = at[hit]
            on = (key < h[open_]) & (at < self.size)
            open_, at = open_[on], at[on] + 1
        return out


def low(keys: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bytes of packed strings."""
    return keys & np.uint64((1 << 8 * n) - 1)


@dataclass
class Level:
    """Nodes of one depth: their weight for stopping here and their estimate of a 1."""

    index: Index
    stop: np.ndarray
    one: np.ndarray


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(values[order], at, axis=0) if len(at) else values[:0]


Sums = list[tuple[np.ndarray, np.ndarray]]


def grown(grams: np.ndarray, counts: np.ndarray, depth: int, least: int = 0, below: Sums | None = None) -> tuple[list[Level], Sums]:
    """The levels from ``least`` to ``depth``, and for each bit the next lower nodes with the sums of their children.

    ``grams``: strings of depth + 1 bytes, the coded byte lowest; ``counts``: how often each was seen;
    ``below``: the sums for level ``depth``, where deeper levels were grown elsewhere.
    """
    # a node's key is its context with the prefix of the byte, led by a 1, as lowest byte; so the eight bits
    # share no node, and each is worked out by itself, in an eighth of the memory
    levels = []
    for d in range(depth, least - 1, -1):
        keys, n = summed(low(grams, d + 1), counts.astype(float))
        context, symbol = keys & ~np.uint64(255), keys & np.uint64(255)
        sums, made = [], []
        for bit in range(8):
            prefix = (ONE << np.uint64(bit)) | (symbol >> np.uint64(8 - bit))
            is_one = (symbol >> np.uint64(7 - bit) & ONE).astype(bool)
            nodes, ab = summed(context | prefix, np.column_stack([np.where(is_one, 0, n), np.where(is_one, n, 0)]))
            a, b = ab[:, 0], ab[:, 1]
            own = log_gamma(a, True) + log_gamma(b, True) - log_gamma(a + b, False) - math.log(math.pi)
            if below is None:
                weighted, stop = own, np.ones(len(nodes))
            else:
                inner, weight = below[bit]
                weighted = np.logaddexp(own, np.bincount(np.searchsorted(nodes, inner), weight, len(nodes))) - math.log(2)
                stop = np.exp(own - math.log(2) - weighted)
            sums.append(summed(low(nodes >> np.uint64(8), max(d - 1, 0)) << np.uint64(8) | (nodes & np.uint64(255)), weighted))
            made.append((nodes, stop.astype(np.float32), ((b + 0.5) / (a + b + 1)).astype(np.float32)))
        below = sums
        index = Index(np.concatenate([m[0] for m in made]))
        levels.append(Level(index, index.sort(np.concatenate([m[1] for m in made])), index.sort(np.concatenate([m[2] for m in made]))))
    return levels[::-1], below


@dataclass
class Tree:
    """The weighted tree, and the logarithm of the probability of strings that were seen: all, or the frequent ones without levels."""

    depth: int
    levels: list[Level] = field(default_factory=list)
    seen: Index | None = None
    logp: np.ndarray | None = None

    @classmethod
    def grow(cls, grams: np.ndarray, counts: np.ndarray, depth: int) -> Tree:
        """``grams``: strings of depth + 1 bytes, the coded byte lowest; ``counts``: how often each was seen."""
        tree = cls(depth, grown(grams, counts, depth)[0])
        tree.seen = Index(grams)
        tree.logp = tree.seen.sort(np.concatenate([tree.walk(grams[k : k + 100_000]) for k in range(0, len(grams), 100_000)] or [np.zeros(0)])).astype(np.float32)
        return tree

    def walk(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the mixture's probability of the lowest byte after the others, bit by bit and depth by depth."""
        out = np.zeros(len(grams))
        symbol = grams & np.uint64(255)
        for bit in range(8):
            prefix = (ONE << np.uint64(bit)) | (symbol >> np.uint64(8 - bit))
            one = np.zeros(len(grams))
            rest = np.ones(len(grams))
            for d, level in enumerate(self.levels):
                at = level.index.find(low(grams >> np.uint64(8), d) << np.uint64(8) | prefix)
                hit = at >= 0
                stop = np.where(hit, level.stop[at], 1.0)
                one += rest * stop * np.where(hit, level.one[at], 0.5)
                rest *= 1 - stop
            is_one = (symbol >> np.uint64(7 - bit) & ONE).astype(bool)
            out += np.log10(np.where(is_one, one, 1 - one))
        return out

    def score(self, grams: np.ndarray) -> np.ndarray:
        at = self.seen.find(grams)
        out = self.logp[at].astype(np.float64)
        new = np.flatnonzero(at < 0)
        if len(new):
            once, inverse = np.unique(grams[new], return_inverse=True)
            out[new] = self.walk(once)[inverse]
        return out


def strings(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """At each byte, it and the ``depth`` bytes before it, packed; before a text stand end marks.

    ``data`` are closed texts: the closing byte of each is read as the end.
    """
    coded = LOWER[data]
    coded[offsets[1:] - 1] = END
    out = coded.astype(np.uint64)
    back = coded
    start = np.zeros(len(coded), bool)
    start[offsets[:-1]] = True
    for k in range(1, depth + 1):
        back = np.concatenate([[END], back[:-1]]).astype(np.uint8)
        # a byte of the text before: everything from its end on is an end mark
        back[start] = END
        if k < depth:
            start = start | np.concatenate([[False], start[:-1]])
        out |= back.astype(np.uint64) << np.uint64(8 * k)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case, and their documents."""
    lower = LOWER[data]
    starts, ends, doc = B.word_spans(lower, offsets)
    return B.span_hash(B.prefix_hash(lower), starts, ends), doc


def _counted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): kind 0 words, 1 strings; summed until GATHER distinct ones are held."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    size = [0, 0]
    small = [0, 0]

    def merge(kind: int) -> None:
        keys, n = summed(*(np.concatenate([x[i] for x in held[kind]]) for i in (0, 1)))
        held[kind] = [(keys, n)]
        small[kind] = size[kind] = len(keys)

    def out(kind: int) -> pa.RecordBatch:
        keys, n = held[kind][0]
        held[kind], size[kind], small[kind] = [], 0, 0
        return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    for batch in batches:
        texts = batch.column(0)
        for a, b in B.slices(texts):
            data, offsets = B.closed(texts.slice(a, b - a))
            for kind, found in enumerate((words(data, offsets)[0], strings(data, offsets, depth))):
                keys, n = np.unique(found, return_counts=True)
                held[kind].append((keys, n.astype(np.int64)))
                size[kind] += len(keys)
                if size[kind] > small[kind] + GATHER:
                    merge(kind)
                    if small[kind] > GATHER:
                        yield out(kind)
    for kind in (0, 1):
        if held[kind]:
            merge(kind)
            yield out(kind)


@dataclass
class Model:
    tree: Tree
    index: Index
    count: np.ndarray
    train_docs: int


@dataclass
class Parts:
    """A tree too large for one place: its strings, dealt out by the ``SHARED`` bytes before the coded one, and the levels above."""

    table: DataFrame
    tasks: int
    depth: int
    top: list[Level]

    @classmethod
    def of(cls, table: DataFrame, size: int, depth: int) -> Parts:
        made = cls(table, -(-size // PART), depth, [])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                grams, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
                _, found = grown(grams.view(np.uint64), n, depth, SHARED)
                yield pa.record_batch([pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(np.concatenate([w for _, w in found]))], names=["key", "n"])

        parts = made.dealt(table.select("key", "n")).mapInArrow(sums, "key long, n double")
        nodes, weights = _columns(parts.groupBy("key").agg(F.sum("n").alias("n")))
        below = [(nodes[at], weights[at]) for at in (np.flatnonzero((nodes & np.uint64(255)) >> np.uint64(bit) == 1) for bit in range(8))]
        short = table.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        made.top = grown(*_columns(short), SHARED - 1, 0, below)[0]
        return made

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.tasks, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1)))

    def logs(self, rows: DataFrame) -> DataFrame:
        """key and n, its log10 probability, of the rows that are ``asked``; ``rows`` has all strings of the training, with key, n, asked."""
        depth, top = self.depth, rows.sparkSession.sparkContext.broadcast(self.top)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                grams, n, asked = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
                grams = grams.view(np.uint64)
                tree = Tree(depth, [*top.value, *grown(grams[n > 0], n[n > 0], depth, SHARED)[0]])
                ask = grams[asked]
                for k in range(0, len(ask), 100_000):
                    some = ask[k : k + 100_000]
                    yield pa.record_batch([pa.array(some.view(np.int64)), pa.array(tree.walk(some).astype(np.float32).astype(float))], names=["key", "n"])

        return self.dealt(rows.select("key", "n", "asked")).mapInArrow(of, "key long, n double")


@dataclass
class Learnt:
    model: Model
    vocabulary: DataFrame
    total: int
    distinct: int
    parts: Parts | None = None


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table of bounded size, by key; as Arrow columns, without a row object each."""
    found = df.select("key", "n").toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


def _least(table: DataFrame, most: int) -> int:
    """The least count n that leaves no more rows than ``most``."""
    by_count = {r["c"]: r["count"] for r in table.groupBy(F.least("n", F.lit(100_000)).alias("c")).count().collect()}
    least, kept = 100_001, 0
    for c in sorted(by_count, reverse=True):
        if kept + by_count[c] > most:
            break
        least, kept = c, kept + by_count[c]
    return least


def learn(texts: DataFrame, text: str = "text", depth: int = DEPTH, most_grams: int = MOST_GRAMS, most_words: int = MOST_WORDS) -> Learnt:
    """Counts of all rows of ``texts``, and the models made of them."""
    counted = texts.select(F.col(text).alias("_text")).mapInArrow(lambda b: _counted(b, depth), "kind int, key long, n long")
    table = staging.stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    docs = texts.count()
    vocabulary = table.where("kind = 0").select("key", "n")
    row = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    keys, times = _columns(vocabulary.where(F.col("n") >= _least(vocabulary, most_words)))
    index = Index(keys)
    strings_ = table.where("kind = 1").select("key", "n")
    size, parts = strings_.count(), None
    if depth < SHARED or size <= most_grams:
        tree = Tree.grow(*_columns(strings_), depth)
    else:
        parts = Parts.of(strings_, size, depth)
        grams, logs = _columns(parts.logs(strings_.withColumn("asked", F.col("n") >= _least(strings_, most_grams))))
        tree = Tree(depth, [], Index(grams))
        tree.logp = tree.seen.sort(logs.astype(np.float32))
    model = Model(tree, index, index.sort(times), docs)
    return Learnt(model, vocabulary, int(row[1]) + docs, int(row[0]) + (docs > 0), parts)


SCORED = "n_words long, known long, logs double, score double, rare array<long>, times array<int>, strange array<long>, often array<int>"


def _listed(keys: np.ndarray, doc: np.ndarray, n: int) -> list[pa.Array]:
    """Lists for ``n`` documents: each key once a document, and its number there."""
    order = np.lexsort((keys, doc))
    h, d = keys[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(d[first], minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]


def _scored(texts: pa.Array, m: Model) -> Iterator[pa.RecordBatch]:
    for a, b in B.slices(texts):
        data, offsets = B.closed(texts.slice(a, b - a))
        n = b - a
        grams = strings(data, offsets, m.tree.depth)
        if m.tree.levels:
            found, far = m.tree.score(grams), np.zeros(0, int)
        else:
            at = m.tree.seen.find(grams)
            found, far = np.where(at >= 0, m.tree.logp[at], 0.0).astype(float), np.flatnonzero(at < 0)
        score = np.add.reduceat(found, offsets[:-1])
        hashes, doc = words(data, offsets)
        at = m.index.find(hashes)
        hit = at >= 0
        known = np.bincount(doc[hit], minlength=n)
        logs = np.bincount(doc[hit], np.log10(m.count[at[hit]] + 1.0), n).astype(float)
        yield pa.record_batch(
            [
                pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                pa.array(known.astype(np.int64)),
                pa.array(logs),
                pa.array(score),
                *_listed(hashes[~hit], doc[~hit], n),
                *_listed(grams[far], np.searchsorted(offsets, far, "right") - 1, n),
            ],
            names=["n_words", "known", "logs", "score", "rare", "times", "strange", "often"],
        )


def score(docs: DataFrame, learnt: Learnt, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns ``keep``, and n_tokens, n_known, train_tokens, base_score, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(learnt.model)
    names = list(keep)
    rows = docs.select(*[c.alias(f"_k{i}") for i, c in enumerate(keep.values())], F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            at = 0
            other = [c for c in batch.schema.names if c != "_text"]
            for part in _scored(batch.column("_text"), m):
                left = batch.slice(at, len(part))
                at += len(part)
                yield pa.record_batch([*[left.column(c) for c in other], *part.columns], names=[*other, *part.schema.names])

    kinds = rows.drop("_text")._jdf.schema().toDDL()
    # written once, so that the row numbers given above stay what they are
    table = staging.stage(rows.mapInArrow(scored, f"{kinds}, {SCORED}"), "scored")
    pairs = table.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("_row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    found = pairs.join(learnt.vocabulary, "key").groupBy("_row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    ends = learnt.model.train_docs
    size = math.log10(learnt.total + learnt.distinct + 1)
    out = table.drop("rare", "times", "strange", "often").join(found, "_row", "left")
    if learnt.parts:
        pairs = table.select("_row", F.explode(F.arrays_zip("strange", "often")).alias("s")).select("_row", F.col("s.strange").alias("key"), F.col("s.often").alias("often"))
        known = learnt.parts.table.select("key", "n", F.lit(False).alias("asked"))
        asked = pairs.select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")).unionByName(known)
        logs = staging.stage(learnt.parts.logs(asked.groupBy("key").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))), "logs")
        rest = pairs.join(logs, "key").groupBy("_row").agg(F.sum(F.col("often") * F.col("n")).alias("rest"))
        out = out.join(rest, "_row", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    return out.select(
        *[F.col(f"_k{i}").alias(name) for i, name in enumerate(names)],
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(learnt.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + math.log10(ends + 1) - (F.col("n_words") + 1) * F.lit(size)).alias("base_score"),
        "score",
    )


def report(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    learnt = learn(docs.where(remainder("doc_id", 7) != 2))
    return score(docs, learnt, {"doc_id": F.col("doc_id"), "held_out": remainder("doc_id", 7) == 2})
