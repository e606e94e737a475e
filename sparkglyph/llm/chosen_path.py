"""N-gram Jaccard join by chosen paths.

A text is the set of the hashes of its five-word shingles (a text of one to four
words is one shingle).  In each of several independent runs every set chooses some of
its tokens, by a hash that all sets share, about ``BOOST / similarity`` of them; each
chosen token leads to a bucket.  Buckets of up to ``BUCKET`` sets are compared outright;
larger ones are split, first by the sizes of their sets (a set near a border is in both
bands, so no pair is parted), then by tokens chosen along the path, several levels at once where
few sets are left, until they are small or dense; a dense one, whose sets share so many tokens that paths don't part them, goes to
verification whole.  A sample of sketches tells dense buckets, and only that.  Two sets of the asked similarity
share a chosen token at a level with probability 1 - exp(-BOOST) at least, and the number
of runs follows from the recall asked for.

Comparing in a bucket is by 128-place sketches with a wide margin; sets that pass form
candidate groups with those of dense buckets.  Each group is then verified
exactly, block against block, by the sizes of intersections, every pair once.  Equal
sets are one entry with a weight; its text is read again by the id and the hash of the
text that stand for it, so many texts under one id, or without one, meet only themselves.
Hot buckets and large groups are few, so their keys are sent to where the rows are; beyond
``MOST_SENT`` both sides of the join are plain tables, which lets Spark split a hot key.
What leaves a block is a count for each set and a
spanning forest of its links.  Nothing is capped: a hot token only means more splits, a
large group more pairs of blocks.

Defined cases: null texts and texts without a word have no shingle and link with
nothing; equal texts link; repeated rows count as documents of their own; a null id
stands for itself and never names a group that has another id; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import staging
from . import bytesops as B
from . import groups
from .components import components
from .text import fresh

SHINGLE, SIMILARITY = 5, 0.8
BOOST, RECALL, DEPTH, BUCKET = 2.0, 0.9999, 8, 1024
#: A large bucket whose sets share so much on average (by the sketches of about SAMPLED of them) is verified as it
#: is: its pairs would share as many paths after a split as before, BOOST / SIMILARITY * 2 * DENSE / (1 + DENSE) = 1.
DENSE, SAMPLED = 0.25, 64
PLACES, MARGIN = 128, 0.55
#: Sets and tokens in a block of the exact comparison.
BLOCK, BLOCK_TOKENS = 1024, 1_250_000
#: Tables of up to so many numbers a column are sent to every executor (8 bytes each); more are joined by a shuffle.
MOST_SENT = 500_000
COLUMNS = 4096
#: A split takes several levels at once while that makes up to so many paths for each class of the table (its first
#: choices are about BOOST / SIMILARITY * runs); every split is a round of jobs, however few the sets.
AT_ONCE = 4


def runs_for(recall: float = RECALL, boost: float = BOOST, depth: int = DEPTH) -> int:
    """Independent runs until a pair of the asked similarity is found with this probability."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-boost * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def shingles(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    data, offsets = B.closed(texts)
    starts, ends, doc = B.word_spans(data, offsets)
    words = B.span_hash(B.prefix_hash(data), starts, ends)
    per = np.bincount(doc, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(per)])
    hashes = B.window_hash(words, n)
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            s = np.sort(hashes[a : b - n + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            raw = words[a:b] * np.array(B.PLACE[: b - a], np.uint64)
            out.append(B.mixed(raw.sum(dtype=np.uint64, keepdims=True) + np.full(1, b - a, np.uint64) * B.MIX1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def choose(tokens: np.ndarray, limit: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are chosen on a path, and the paths they lead to."""
    u = B.mixed(tokens ^ path)
    hit = np.flatnonzero(u < limit)
    return hit, B.mixed(u[hit] + (path[hit] if len(path) > 1 else path))


def limit_of(size: int, similarity: float) -> int:
    return min(2**64 - 1, int(BOOST / (similarity * max(size, 1)) * 2.0**64))


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of 128 ranges of hashes, a byte of its least one; 0 if there is none."""
    out = np.zeros(PLACES, np.uint8)
    place = (s >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = place[1:] != place[:-1]
    out[place[first]] = 1 + (s[first] % np.uint64(255)).astype(np.uint8)
    return out


SETS = "id long, th long, cls long, n int, sketch binary, keys array<long>"


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def identity(s: np.ndarray) -> int:
    """A hash of a set, the name of its class."""
    return int(signed(B.mixed(np.array([B.mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))])))[0]) if len(s) else 0


def _sets(batches: Iterator[pa.RecordBatch], runs: int, similarity: float) -> Iterator[pa.RecordBatch]:
    seeds = B.mixed(np.arange(1, runs + 1, dtype=np.uint64) * B.MIX2)
    for batch in batches:
        texts = batch.column(1)
        for a, b in B.slices(texts):
            sets = shingles(texts.slice(a, b - a))
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            limit = np.repeat(np.array([limit_of(n, similarity) for n in size], np.uint64), size)
            owner = np.repeat(np.arange(len(sets)), size)
            keys, of = [], []
            for seed in seeds:
                hit, to = choose(flat, limit, np.array([seed]))
                keys.append(to)
                of.append(owner[hit])
            keys, of = np.concatenate(keys), np.concatenate(of)
            order = np.argsort(of, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sets)))]).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.array([identity(s) for s in sets], pa.int64()),
                    pa.array(size, pa.int32()),
                    pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(keys[order]))),
                ],
                names=["id", "th", "cls", "n", "sketch", "keys"],
            )


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A staged table, marked to be sent to every executor if its rows are few enough for that."""
    return F.broadcast(df) if df.count() <= most else df


def _with_sets(docs: DataFrame, wanted: DataFrame, few: bool, make: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows that ``make`` gives for rows of ``wanted`` (cls, rep, th and more) and the sets of their classes.

    Sets are made again from the representatives' texts and used in the same task, so they are never
    stored here.  A class comes as often as its representative's row is repeated.
    """
    more = [c for c in wanted.columns if c not in ("cls", "rep", "th")]
    rows = docs.join(F.broadcast(wanted) if few else wanted, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_th") == F.col("th"))).select("cls", "_text", *more)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in B.slices(texts):
                yield make(batch.slice(a, b - a), shingles(texts.slice(a, b - a)))

    return rows.mapInArrow(made, schema)


def alike(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs' sizes and sketches allow the similarity, with a wide margin."""
    same = ((x == y) & (x > 0)).sum(axis=1)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (same >= MARGIN * ((x | y) > 0).sum(axis=1))


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PLACES)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the buckets whose sampled sets are similar on average, as their sketches tell."""
    for table in groups.cut(batches, ("key",)):
        at = groups.bounds(table, ("key",))
        sk, found = sketches(table.column("sketch")), []
        for s, e in zip(at[:-1], at[1:], strict=True):
            x = sk[s:e]
            same = ((x[:, None] == x[None]) & (x[None] > 0)).sum(axis=2)
            share = same / np.maximum((x[:, None] | x[None] > 0).sum(axis=2), 1)
            if e - s < 2 or (share.sum() - np.trace(share)) / ((e - s) * (e - s - 1)) >= DENSE:
                found.append(s)
        yield pa.record_batch([pa.array(table.column("key").to_numpy()[found])], names=["key"])


def _dense_keys(some: DataFrame, shapes: DataFrame) -> list[int]:
    """The same for few buckets: their sampled sketches, of a bounded number, are looked at here."""
    table = F.broadcast(some).join(shapes, "cls").select("key", "sketch").toArrow().sort_by("key").combine_chunks()
    return [k for batch in _dense(iter(table.to_batches())) for k in batch.column("key").to_pylist()]


def levels_for(steps: int, depth: int, most: int, similarity: float = SIMILARITY) -> int:
    """How many levels to split at once: more than one while so many steps lead to up to ``most`` paths, as far as expected."""
    levels = 1
    while depth + levels < DEPTH and steps * (BOOST / similarity) ** (levels + 1) <= most:
        levels += 1
    return levels


def _near(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Within each bucket (sorted by size), pairs whose sizes and sketches allow the similarity, as a spanning forest."""
    key, cls, n = (table.column(c).to_numpy() for c in ("key", "cls", "n"))
    sk = sketches(table.column("sketch"))
    forest = groups.Forest(len(table))
    i = np.arange(len(table))
    for d in range(1, len(table)):
        i = i[: np.searchsorted(i, len(table) - d)]
        i = i[(key[i] == key[i + d]) & (n[i] >= similarity * n[i + d] - 1e-9)]  # none farther on, as sizes grow
        if not len(i):
            break
        for a in range(0, len(i), 4096):
            x = i[a : a + 4096]
            for p in x[alike(n[x], n[x + d], sk[x], sk[x + d], similarity)].tolist():
                forest.union(p, p + d)
    root = np.array([forest.find(k) for k in range(len(table))], int)
    moved = np.flatnonzero(root != np.arange(len(table)))
    return cls[moved], cls[root[moved]]


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of left sets with right ones (None: with themselves)."""
    both = left if right is None else [*left, *right]
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both), dtype=np.int32), [len(s) for s in both])
    order = np.argsort(flat, kind="stable")
    s, owner = flat[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.cumsum(new, dtype=np.int32) - 1
    shared = np.bincount(number)[number] > 1
    owner = owner[shared]
    _, number = np.unique(number[shared], return_inverse=True)
    out = np.zeros((len(left), len(both) - len(left) if right is not None else len(left)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(number, [a, a + COLUMNS])
        m = np.zeros((len(both), COLUMNS), np.float32)
        m[owner[lo:hi], number[lo:hi] - a] = 1
        out += m[: len(left)] @ (m if right is None else m[len(left) :]).T
    return out


def _verify(table: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at = groups.bounds(table, ("grp", "low", "high", "cls"))  # repeated rows of one id give a class twice
    table = table.take(pa.array(at[:-1]))
    at = groups.bounds(table, ("grp", "low", "high"))
    cls, mult, block, low, high = (table.column(c).to_numpy() for c in ("cls", "mult", "block", "low", "high"))
    tokens = table.column("tokens")
    for s, e in zip(at[:-1], at[1:], strict=True):
        sets = [np.frombuffer(t, np.uint64) for t in tokens.slice(s, e - s).to_pylist()]
        size = np.array([len(t) for t in sets])
        first = block[s:e] == low[s]
        if low[s] == high[s]:
            left = right = np.arange(e - s)
            inter = intersections(sets, None)
        else:
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(left) or not len(right):
                continue
            inter = intersections([sets[k] for k in left], [sets[k] for k in right])
        hit = inter >= similarity * (size[left][:, None] + size[right][None, :] - inter) - 1e-6
        if low[s] == high[s]:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        i, j = left[i], right[j]
        links = np.bincount(i, mult[s:e][j], e - s) + np.bincount(j, mult[s:e][i], e - s)
        forest = groups.Forest(e - s)
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            forest.union(p, q)
        touched = np.flatnonzero(links)
        yield cls[s:e][touched], links[touched].astype(np.int64), cls[s:e][[forest.find(k) for k in touched.tolist()]]


def _candidates(docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of classes, as forests, that connect all classes which the chosen paths bring together."""
    shapes = classes.select("cls", "n", "sketch")
    paths = classes.select(F.explode("keys").alias("key"), "cls")
    bits = [F.length(F.bin(x)) for x in (F.col("n").cast("long"), F.floor(F.col("n") / similarity + 1e-9))]
    leaves: list[DataFrame] = []
    pairs: list[DataFrame] = []
    depth = 0
    while True:
        sizes = staging.stage(paths.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("least")).where("size > 1"), "sizes")
        hot, small = sizes.where(F.col("size") > BUCKET), sizes.where(F.col("size") <= BUCKET).select("key")
        buckets = hot.count()
        if not buckets:
            leaves.append(paths.join(small, "key"))
            break
        hot = F.broadcast(hot) if buckets <= MOST_SENT else hot
        leaves.append(paths.join(hot, "key", "left_anti").join(small, "key"))
        held = paths.join(hot, "key")
        some = held.where(F.pmod(F.xxhash64("cls", "key"), F.lit(1 << 30)) < F.lit(SAMPLED << 30) / F.col("size")).select("key", "cls")
        if depth == DEPTH:
            dense = hot.select("key")
        elif buckets * SAMPLED * PLACES <= 8 * MOST_SENT:
            dense = hot.where(F.col("key").isin(_dense_keys(some, shapes))).select("key")
        else:
            dense = groups.dealt(some.join(shapes, "cls").select("key", "sketch"), ("key",)).mapInArrow(_dense, "key long")
            dense = sent(staging.stage(dense, "dense"))
        pairs.append(held.join(dense, "key", "left_semi").select(F.col("cls").alias("a"), F.col("least").alias("b")))
        if depth == DEPTH:
            break
        rest = held.join(dense, "key", "left_anti").select("key", "cls")
        if not depth:
            banded = rest.join(classes.select("cls", "n"), "cls").select("key", "cls", F.explode(F.array_distinct(F.array(*bits))).alias("band"))
            paths = staging.stage(banded.select(F.xxhash64("key", "band").alias("key"), "cls"), "bands")
            depth = 1
            continue
        # a class is in as many large buckets as it chose hot tokens, a number that its choices bound
        open_ = rest.groupBy("cls").agg(F.collect_list("key").alias("paths"))
        open_ = staging.stage(open_.join(classes.select("cls", "rep", "th"), "cls"), "open")
        count, steps = open_.agg(F.count(F.lit(1)), F.sum(F.size("paths"))).first()
        if not count:
            break
        levels = levels_for(steps, depth, AT_ONCE * classes.count(), similarity)
        depth += levels

        def split(rows: pa.RecordBatch, sets: list[np.ndarray], levels: int = levels) -> pa.RecordBatch:
            to, cls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for one, s, paths_ in zip(rows.column("cls").to_pylist(), sets, rows.column("paths").to_pylist(), strict=True):
                limit, keys = np.uint64(limit_of(len(s), similarity)), np.array(paths_, np.int64).view(np.uint64)
                for _ in range(levels):
                    keys = np.concatenate([np.zeros(0, np.uint64), *(choose(s, limit, keys[k : k + 1])[1] for k in range(len(keys)))])
                to.append(signed(keys))
                cls.append(np.full(len(keys), one))
            return pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (to, cls)], names=["key", "cls"])

        paths = staging.stage(_with_sets(docs, open_, 3 * count + steps <= MOST_SENT, split, "key long, cls long").distinct(), "paths")

    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups.cut(batches, ("key",)):
            a, b = _near(table, similarity)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    found = groups.dealt(rows.join(shapes, "cls").select("key", "cls", "n", "sketch"), ("key",), ("n",)).mapInArrow(near, "a long, b long")
    for more in pairs:
        found = found.unionByName(more)
    return found


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """id, th (the text's hash), cls (names the set), comp (names the group), n_links, component_id of every row.

    ``cls`` and ``comp`` are null for a text without a word; ids must fit a long.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_th"))
    runs = runs_for(recall)
    sets = staging.stage(docs.mapInArrow(lambda b: _sets(b, runs, similarity), SETS), "sets")
    classes = sets.where("n > 0").groupBy("cls").agg(
        F.min("id").alias("rep"), F.coalesce(F.min_by("th", "id"), F.min("th")).alias("th"), F.count(F.lit(1)).alias("mult"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")
    )
    classes = staging.stage(classes, "classes")
    of = staging.stage(components(_candidates(docs, classes, similarity)), "candidates")
    grouped = of.select(F.col("node").alias("cls"), F.col("component").alias("grp")).unionByName(of.select(F.col("component").alias("cls"), F.col("component").alias("grp")).distinct())
    members = staging.stage(grouped.join(classes.select("cls", "rep", "th", "mult", "n"), "cls"), "groups")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    sizes = staging.stage(sizes.where("blocks > 1"), "large-groups")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = members.join(sent(sizes), "grp", "left").select("cls", "rep", "th", "grp", "mult", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))

    def spelled(rows: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        names = ["grp", "mult", "blocks", "block", "cls"]
        return pa.record_batch([*[rows.column(c) for c in names], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "tokens"])

    full = _with_sets(docs, placed, 4 * members.count() <= MOST_SENT, spelled, "grp long, mult long, blocks int, block int, cls long, tokens binary")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "mult", "tokens")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups.cut(batches, ("grp", "low", "high")):
            for cls, links, root in _verify(table, similarity):
                yield pa.record_batch([pa.array(cls), pa.array(links), pa.array(root)], names=["cls", "links", "root"])

    found = staging.stage(groups.dealt(full, ("grp", "low", "high"), ("cls",)).mapInArrow(verified, "cls long, links long, root long"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(found, "cls", "root")
    whole = (
        classes.select("cls", "rep", "mult")
        .join(links, "cls", "left")
        .join(linked, F.col("cls") == F.col("node"), "left")
        .select("cls", "rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cls").alias("comp"))
    )
    # a class of one document without links is a group of its own and needs no look-up
    whole = staging.stage(whole.where("n_links > 0"), "classes-linked")
    named = staging.stage(whole.groupBy("comp").agg(F.min("rep").alias("component_id")), "named")
    of_class = staging.stage(whole.join(sent(named), "comp").select(F.col("cls").alias("_cls"), "comp", "n_links", "component_id"), "of-class")
    out = sets.select("id", "th", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(sent(of_class, MOST_SENT // 4), F.col("cls") == F.col("_cls"), "left")
    alone = F.col("_cls").isNull()
    return out.select("id", "th", "cls", F.coalesce("comp", "cls").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = join(docs)
    return found.select(F.col("id").alias("doc_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked ones.

    That of the least id stays (a null id comes last), then that of the least hash of its text;
    of rows with the same id and text, the one whose columns' hash is least.  Rows without a
    word stay, all of them.
    """
    g_id, g_th, one, whole = fresh(docs, "_gone_id", "_gone_th", "_one", "_whole")
    found = staging.stage(join(docs, doc_id, text).where("n_links > 0").select("comp", F.col("id").isNull().alias("void"), F.col("id").alias(g_id), F.col("th").alias(g_th)), "joined")
    first = staging.stage(found.groupBy("comp").agg(F.min(F.struct("void", g_id, g_th)).alias(one)), "first")
    is_first = F.col(g_id).eqNullSafe(F.col(f"{one}.{g_id}")) & (F.col(g_th) == F.col(f"{one}.{g_th}"))
    judged = staging.stage(found.join(sent(first, MOST_SENT // 4), "comp").select(g_id, g_th, is_first.alias(one)), "judged")
    gone = staging.stage(judged.where(f"not {one}").select(g_id, g_th).distinct(), "gone")
    twice = staging.stage(judged.where(one).groupBy(g_id, g_th).count().where("count > 1").select(g_id, g_th), "twice")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(g_id)) & (F.xxhash64(text) == F.col(g_th))
    left = docs.join(sent(gone), same, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return left
    again = left.join(sent(twice), same).groupBy(g_id, g_th).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(whole))
    return left.join(sent(twice), same, "left_anti").unionByName(again.select(f"{whole}.*"))


#: The same by an inverted index of the shingles themselves, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_links, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) x ON x.a = doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) y ON y.a = doc_id
"""
