"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample gives the reference points (pivots), spread out so that no two are
close.  Each vector is described by its nearest pivots in order, the head of its
permutation; the head grows with the number of pivots, so that recall does not fall with
it.  Inverted lists are kept for pairs of pivots: two vectors meet in as
many of them as they have pairs of pivots in common, so meeting at all means a
shared-pivot count of two or more.  Within a list, a pair is looked at only where the
two lowest pivots that it shares are the list's own; so every retrieved pair is
verified once, by its cosine in double precision, however often it meets.

A list of more than ``BLOCK`` vectors is dealt out as pairs of blocks.  Copies of one
vector are one entry with a weight.  What leaves a block is a count for each vector
and a spanning forest of its links, never the pairs; components come from the forests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are components of their own; only vectors of the same length are
compared, those of other lengths than the sample's in lists of their own; repeated rows
(id and vector) are one vector among the links, and each of them gives a row; an id with
two vectors gives two rows; a null id links with nothing and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import staging
from . import groups
from .components import components

NEAREST, MOST_PIVOTS, LEAST_PIVOTS, BLOCK = 6, 1024, 64, 1024
APART = 0.7
COSINE = 0.9
#: Distinct vectors whose results are sent to every executor (32 bytes each); more are joined by a shuffle.
MOST_SENT = 250_000


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = column.offsets.to_numpy()
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[at[i] : at[i + 1]] if ok[i] else None for i in range(len(column))]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def usable(column: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(column.isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of the sample, no two with a cosine over APART while others are left."""
    chosen: list[int] = []
    near = np.full(len(sample), -1.0)
    for i in range(len(sample)):
        if near[i] <= APART:
            chosen.append(i)
            if len(chosen) == most:
                break
            near = np.maximum(near, sample @ sample[i])
    return sample[chosen]


def heads(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row, nearest first; ties to the lower number."""
    k = min(k, len(pivots))
    sims = np.round(x @ pivots.T, 12)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def head_size(nearest: int, pivots: int) -> int:
    """Places of the heads: ``nearest`` up to 128 pivots, and one more each time their number doubles."""
    return nearest + max(0, math.ceil(math.log2(max(1, pivots) / 128)))


def pair_keys(head: np.ndarray) -> np.ndarray:
    """Numbers of all pairs of pivots of each head."""
    low = np.sort(head, axis=1).astype(np.int64)
    i, j = np.triu_indices(low.shape[1], 1)
    return low[:, i] << 32 | low[:, j]


def linked(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, key: int, cosine: float) -> np.ndarray:
    """Which pairs of x and y are linked and belong to this list."""
    hit = x @ y.T >= cosine
    if key >= 0 and hit.any():
        a, b = key >> 32, key & 0xFFFFFFFF
        ids = np.unique(np.concatenate([hx.ravel(), hy.ravel()]))
        ids = ids[(ids < b) & (ids != a)]
        if len(ids):  # a shared pivot below the list's own: the pair belongs to another list
            mx = (hx[:, :, None] == ids).any(axis=1).astype(np.float32)
            my = (hy[:, :, None] == ids).any(axis=1).astype(np.float32)
            hit &= mx @ my.T < 0.5
    return hit


def _verify(table: pa.Table, kind: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    keys = ("key", "low", "high")
    at = groups.bounds(table, keys)
    col = {c: table.column(c).to_numpy() for c in ("key", "low", "high", "rep", "mult", "block")}
    vectors, head = table.column("vector"), table.column("head")
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s < 2:
            continue
        x = unit(np.frombuffer(b"".join(vectors.slice(s, e - s).to_pylist()), kind).reshape(e - s, -1).astype(np.float64))
        h = np.frombuffer(b"".join(head.slice(s, e - s).to_pylist()), np.int32).reshape(e - s, -1)
        rep, mult, low = col["rep"][s:e], col["mult"][s:e], col["block"][s:e] == col["low"][s]
        if col["low"][s] == col["high"][s]:
            hit = np.triu(linked(x, x, h, h, int(col["key"][s]), COSINE), 1)
            i, j = np.nonzero(hit)
            left = right = np.arange(e - s)
        else:
            left, right = np.flatnonzero(low), np.flatnonzero(~low)
            i, j = np.nonzero(linked(x[left], x[right], h[left], h[right], int(col["key"][s]), COSINE))
        if not len(i):
            continue
        i, j = left[i], right[j]
        links = np.bincount(i, mult[j], e - s) + np.bincount(j, mult[i], e - s)
        forest = groups.Forest(e - s)
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            forest.union(p, q)
        touched = np.flatnonzero(links)
        roots = np.array([forest.find(int(t)) for t in touched])
        yield rep[touched], links[touched].astype(np.int64), rep[roots]


def duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", nearest: int = NEAREST, seed: int = 9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    # lists hold components as wide as the column has them; cosines are always in double precision
    kind = np.float32 if "array<float>" in vectors.schema[embedding].dataType.simpleString() else np.float64
    v = vectors.select(F.col(vec_id).alias("_id"), F.transform(embedding, lambda x: x.cast("double")).alias("_v"))
    v = v.withColumn("_ok", usable(F.col("_v"))).withColumns({"_h1": F.xxhash64("_v"), "_h2": F.hash("_v")})
    members = staging.stage(v.where("_ok and _id is not null").groupBy("_id", "_h1", "_h2").agg(F.first("_v").alias("_v")), "vectors")
    reps = staging.stage(members.groupBy("_h1", "_h2").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("_v").alias("_v")), "vector-reps")
    sizes = reps.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    n, dim = (sizes[0]["count"], sizes[0]["d"]) if sizes else (0, 0)
    most = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 ** round(math.log2(max(1.0, math.sqrt(n)))))))
    share = min(1.0, 8 * most / max(1, n))
    some = reps.where((F.size("_v") == dim) & (F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))).select("rep", "_v").toPandas().sort_values("rep")
    pivots = spread(unit(np.array(some["_v"].tolist(), float)), most) if len(some) else np.zeros((0, dim))
    held = spark.sparkContext.broadcast(pivots)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in batches:
            x = rows_of(batch.column("_v"))
            n = len(x)
            keys: list[list[int]] = [[]] * n
            head = [b""] * n
            main = [i for i in range(n) if len(x[i]) == p.shape[1]]
            if main:
                h = heads(unit(np.stack([x[i] for i in main])), p, head_size(nearest, len(p)))
                k = pair_keys(h) if h.shape[1] > 1 else np.zeros((len(main), 1), np.int64)
                for r, i in enumerate(main):
                    keys[i], head[i] = k[r].tolist(), h[r].astype(np.int32).tobytes()
            for i in range(n):
                if not keys[i]:  # a list for each other length
                    keys[i], head[i] = [-1 - len(x[i])], np.zeros(1, np.int32).tobytes()
            yield pa.record_batch([batch.column("rep"), batch.column("mult"), pa.array([a.astype(kind).tobytes() for a in x], pa.binary()), pa.array(head, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "mult", "vector", "head", "keys"])

    lists = staging.stage(reps.select("rep", "mult", "_v").mapInArrow(listed, "rep long, mult long, vector binary, head binary, keys array<long>"), "vector-lists")
    sizes_of = lists.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # a row for each pair of pivots, MOST_PIVOTS ** 2 / 2 at most, and one for each other length of a vector
    rows = lists.select("rep", "mult", "vector", "head", F.explode("keys").alias("key")).join(F.broadcast(sizes_of), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "mult", "vector", "head")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups.cut(batches, ("key", "low", "high")):
            for rep, links, root in _verify(table, kind):
                yield pa.record_batch([pa.array(rep), pa.array(links), pa.array(root)], names=["rep", "links", "root"])

    found = staging.stage(groups.dealt(rows, ("key", "low", "high")).mapInArrow(verified, "rep long, links long, root long"), "vector-links")
    staging.drop(lists)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = components(found, "rep", "root")
    per = (
        reps.select("_h1", "_h2", "rep", "mult")
        .join(links, "rep", "left")
        .join(of, F.col("rep") == F.col("node"), "left")
        .select("_h1", "_h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    per = staging.stage(per, "vector-classes")
    linking = F.col("_ok") & F.col("_id").isNotNull()
    # the join's key is null for vectors that link with nothing
    rows = v.select("_id", F.when(linking, F.col("_h1")).alias("_h1"), F.when(linking, F.col("_h2")).alias("_h2"))
    found = rows.join(F.broadcast(per) if per.count() <= MOST_SENT else per, ["_h1", "_h2"], "left")
    component = F.coalesce("component_id", "_id")
    return found.select(F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


#: The same by brute force: all pairs, and the closure of their links.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) x ON x.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) y ON y.a = vec_id
"""
