"""Mixing sources to target weights by the cube method.

A source's target divided by its words is the number of times that each of its
documents is to be taken on average.  The whole part of that number is taken of
every document; the rest is an inclusion probability, and which documents get
the extra copy is settled by balanced sampling: probabilities move through the
null-space of the constraints (documents, words), so both totals stay as they
are while one unit after another becomes 0 or 1.

At scale a source is dealt into blocks of about ``BLOCK`` documents by a hash.
Each block is flown alone and leaves two undecided units at most; those are
gathered and flown again, level by level, until a source fits one block.  There
a landing picks, of the roundings of ``HELD`` units and the last two, the best
balanced one.  A source
with a third of all rows is so many more blocks; no group is larger than about
``BLOCK`` rows.

Defined cases: a null or empty text has size 0 and takes part with size 0; a
null source is a source of its own, sorted last; rows that repeat are units of
their own (rows of one id, source, text and size are counted, not gathered); an empty
table gives an empty result; more than ``MOST_SOURCES`` sources are an error, as each
needs a stated weight; only the named columns are read, so that other columns' names
don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import staging
from .text import count_words, fresh

BLOCK = 2000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
#: Units that a source's last block keeps for the landing, besides the two that the flight leaves.
HELD = 12
#: Sources whose totals the driver holds; a weight must be stated for each, so they are few.
MOST_SOURCES = 1_000_000
EDGE = 1e-9
#: Equal rows that one task makes from their number, and parts in which equal rows are numbered.
CHUNK, PARTS = 10_000, 64
#: Rows of (id, key, number, copies) that are sent to every executor, at most: 24 bytes each before Spark's own.
MOST_SENT = 500_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Share out ``share`` of all words by weight; no source gets over ``limit`` times its own."""
    caps = [limit * s for s in sizes]
    out: list[float | None] = [None] * len(sizes)
    left = share * sum(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > caps[i]]
        for i in over or free:
            out[i] = caps[i] if over else left * weights[i] / total
        if not over:
            break
        left -= sum(caps[i] for i in over)
        free = [i for i in free if out[i] is None]
    return [float(x) for x in out]


def flight(p: list[float], x: list[float], rand: Iterator[float]) -> list[int]:
    """Move ``p`` in place until two units at most are undecided; returns those.

    Three units at a time: the vector orthogonal to (1, 1, 1) and to their sizes
    is the direction; the two step lengths to the border of the unit cube are drawn
    so that every expectation stays.
    """
    hand: list[int] = []
    rest = iter([i for i in range(len(p)) if EDGE < p[i] < 1 - EDGE])
    while True:
        while len(hand) < 3:
            i = next(rest, None)
            if i is None:
                return hand
            hand.append(i)
        a, b, c = hand
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, v in zip(hand, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if next(rand) * (up + down) < down else -down
        for i, v in zip(hand, u, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q < EDGE else 1.0 if q > 1 - EDGE else q
        hand = [i for i in hand if 0.0 < p[i] < 1.0]


def landing(p: list[float], x: list[float], open_: list[int]) -> None:
    """Round the undecided units: of all roundings, the one nearest the totals of words and, at a tie, of documents."""
    n = len(open_)
    ways = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(float)
    moved = ways - np.array([p[i] for i in open_])
    words = np.abs(moved @ np.array([x[i] for i in open_])) / max(1.0, sum(x) / max(1, len(x)))
    best = int(np.argmin(np.round(words + 0.25 * np.abs(moved.sum(axis=1)), 9)))
    for k, i in enumerate(open_):
        p[i] = float(ways[best, k])


def _fly(frame: pd.DataFrame, seed: int) -> pd.DataFrame:
    last = int(frame["_blocks"].iloc[0]) == 1
    # long documents first: what is left for the landing is short
    frame = frame.sort_values(["_size", "_order", "_id", "_occ"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    p, x = frame["_p"].tolist(), frame["_size"].astype(float).tolist()
    rng = np.random.default_rng([seed, int(frame["_s"].iloc[0]), int(frame["_block"].iloc[0]), int(last)])

    def draws() -> Iterator[float]:
        while True:
            yield from rng.random(1024).tolist()

    held: dict[int, float] = {}
    if last:  # a few units of all sizes stay undecided for the landing
        free = [i for i in range(len(p)) if EDGE < p[i] < 1 - EDGE]
        held = {free[k]: p[free[k]] for k in sorted({round(k) for k in np.linspace(0, len(free) - 1, HELD)})} if free else {}
        for i in held:
            p[i] = 0.0
    open_ = flight(p, x, draws())
    if last:
        for i, q in held.items():
            p[i] = q
        landing(p, x, [*open_, *held])
    frame["_p"] = p
    return frame


def source_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[tuple]:
    """(source, number, documents, words, target) of each source, by code point, null last."""
    rows = sized.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; weights must be stated by source")
    rows = sorted(rows, key=lambda r: (r["_source"] is None, r["_source"] or ""))
    goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, limit)
    return [(r["_source"], i, r["n"], int(r["size"]), g) for i, (r, g) in enumerate(zip(rows, goal, strict=True))]


def spread_out(groups: DataFrame, count: str, number: str) -> DataFrame:
    """Each row ``count`` times, with ``number`` from 0; a large group is dealt out in parts first."""
    first = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    if not groups.where(F.col(count) > CHUNK).isEmpty():
        first = first.repartition(*groups.columns, "_from")
    last = F.least(F.col("_from") + CHUNK, F.col(count)) - 1
    return first.select(*[c for c in groups.columns if c != count], F.explode(F.sequence(F.col("_from").cast("int"), last.cast("int"))).alias(number))


def numbered(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Rows that repeat, numbered from 0 within their keys, in parts of the files they are staged in."""
    part, at, before, *own = fresh(rows, "_part", "_at", "_before", *[f"_key{i}" for i in range(len(keys))])
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    placed = rows.select("*", place.alias(at)).withColumn(part, F.pmod(F.xxhash64(at), F.lit(PARTS)))
    sums = Window.partitionBy(*own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(part).alias(before + "p")).count().withColumnRenamed(before + "p", part)
    counts = counts.withColumn(before, F.coalesce(F.sum("count").over(sums), F.lit(0))).withColumnRenamed(part, before + "p").drop("count")
    same = F.col(part) == F.col(before + "p")
    for k, o in zip(keys, own, strict=True):
        same &= F.col(k).eqNullSafe(F.col(o))
    inner = Window.partitionBy(*keys, part).orderBy(at)
    found = placed.withColumn(number, F.row_number().over(inner)).join(counts, same)
    return found.withColumn(number, (F.col(number) + F.col(before) - 1).cast("int")).select(*[F.col(f"`{c}`") for c in rows.columns], number)


def decide(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per document: ``_id, _source, _size, _h`` (of the text), ``_occ`` (from 0, among equal rows), ``_source_size, _target, _copies``."""
    spark = docs.sparkSession
    raw = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.xxhash64(text).alias("_h"), count_words(F.col(text)).alias("_size"))
    sized = staging.stage(raw, "mix-sizes")
    plan = source_plan(sized, weights, share, limit)
    of = spark.createDataFrame(
        [(s, i, n, size, t, (t / size) if size else 0.0, max(1, math.ceil(n / block))) for s, i, n, size, t in plan],
        "_source string, _s int, _n long, _source_size long, _target double, _ratio double, _blocks int",
    )
    same = sized.withColumn("_source", F.col("_source").cast("string")).groupBy("_id", "_source", "_size", "_h").agg(F.count(F.lit(1)).alias("_k"))
    units = (
        spread_out(same, "_k", "_occ")
        .join(of.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
        .withColumn("_order", F.xxhash64("_id", "_occ", "_h", F.lit(seed)))
        .withColumn("_block", F.pmod(F.col("_order"), F.col("_blocks")).cast("int"))
        .withColumn("_whole", F.floor("_ratio").cast("int"))
        .withColumn("_p", F.col("_ratio") - F.floor("_ratio"))
        .select("_id", "_source", "_size", "_h", "_occ", "_source_size", "_target", "_s", "_order", "_block", "_blocks", "_whole", "_p")
    )
    fractional = (F.col("_p") > EDGE) & (F.col("_p") < 1 - EDGE)
    settled: list[DataFrame] = []
    blocks = max([1, *(max(1, math.ceil(n / block)) for _, _, n, _, _ in plan)])
    while True:
        last = blocks == 1
        schema = units.schema

        units = staging.stage(units.groupBy("_s", "_block").applyInPandas(lambda frame: _fly(frame, seed), schema), "mix-flight")
        if last:
            settled.append(units)
            break
        settled.append(units.where(~fractional))
        # two units a block are left at most, so so many blocks meet in one
        together = max(2, block // 2)
        units = units.where(fractional).withColumn("_block", F.floor(F.col("_block") / together).cast("int")).withColumn("_blocks", F.ceil(F.col("_blocks") / together).cast("int"))
        blocks = math.ceil(blocks / together)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("_id", "_source", "_size", "_h", "_occ", "_source_size", "_target", (F.col("_whole") + F.round("_p").cast("int")).alias("_copies"))


def row_key(text_hash: Column, source: Column) -> Column:
    """One number for a text's hash and its source; a null source is unlike any other."""
    return F.xxhash64(text_hash, F.coalesce(source, F.lit("")), source.isNull())


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all, once, twice).

    Ids, keys (hashes of text and source) and numbers of copies travel; up to ``MOST_SENT`` of them go to every
    executor, more are joined by a shuffle.  Only rows that repeat are numbered.
    """
    tid, tkey, tocc, copies, copy, key, kocc = fresh(docs, "_tid", "_tkey", "_tocc", "_copies", "_copy", "_key", "_kocc")
    decided = decide(docs, doc_id, source, text, **options)
    taken = staging.stage(decided.select(F.col("_id").alias(tid), row_key(F.col("_h"), F.col("_source")).alias(tkey), F.col("_occ").alias(tocc), F.col("_copies").alias(copies)), "mix-taken")
    many = staging.stage(taken.where(F.col(tocc) > 0).select(F.col(tid).alias("i"), F.col(tkey).alias("k")).distinct(), "mix-repeated")
    own = row_key(F.xxhash64(text), F.col(source).cast("string"))

    def match(i: str, k: str) -> Column:
        return F.col(doc_id).eqNullSafe(F.col(i)) & (own == F.col(k))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= MOST_SENT else df

    def times(joined: DataFrame) -> DataFrame:
        return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])

    some = taken.where(F.col(copies) > 0)
    if many.isEmpty():
        return times(docs.join(sent(some.select(tid, tkey, copies)), match(tid, tkey)))
    # of rows that don't repeat the number is 0, of the others it is counted
    several = match("i", "k")
    single = docs.join(sent(many), several, "left_anti").join(sent(some.select(tid, tkey, copies)), match(tid, tkey))
    repeated = staging.stage(docs.join(sent(many), several, "left_semi").withColumn(key, own), "mix-repeats")
    repeated = numbered(repeated, [doc_id, key], kocc)
    return times(single).unionAll(times(repeated.join(sent(some), match(tid, tkey) & (F.col(kocc) == F.col(tocc)))))


def report(docs: DataFrame) -> DataFrame:
    """The query's columns: what the mix takes of each document."""
    return decide(docs).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
    )
