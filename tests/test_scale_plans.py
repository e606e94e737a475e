"""Plans for hot groups against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkglyph.operators import match, robust, sequence, stats
from sparkglyph.raster import kernels as K


def test_medians_of_hot_and_empty_groups(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.random(), 0.5])) for _ in range(5001)] + [("one", 3.0), ("two", 1.0), ("two", 4.0), ("none", None), (None, 2.0)]
    got = {r.g: (r.own, r.n) for r in robust.exact_medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    hot = [v for g, v in rows if g == "hot"]
    assert got == {"hot": (float(np.median(hot)), 5001), "one": (3.0, 1), "two": (2.5, 2), "none": (None, 0), None: (2.0, 1)}


def test_pages_in_ranges(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(40), i) for i in range(900)] + [(None, None, 1), (None, 3, 2), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, o int, i int")
    plain = {(r.g, r.i): (r.page, r.band) for r in sequence.pages(df, ["g"], ["o", "i"], 7).collect()}
    assert {(r.g, r.i): (r.page, r.band) for r in sequence.pages(df, ["g"], ["o", "i"], 7, most=50).collect()} == plain
    assert len(plain) == len(rows)


def test_nearest_by_cells_matches_all_pairs(spark):
    rng = random.Random(3)
    points = [(rng.randrange(3), i, rng.uniform(-50, 50)) for i in range(300)]
    anchors = [(rng.randrange(3), i, float(rng.randrange(-50, 50)), rng.choice([0.1, 1.0, 4.0])) for i in range(60)]
    got = {r.p: (r.a, r.distance) for r in match.nearest_within(spark.createDataFrame(points, "g int, p int, v double"), spark.createDataFrame(anchors, "g int, a int, at double, most double"), "g", "p", "v", "a", "at", F.col("most")).collect()}
    want = {}
    for g, p, v in points:
        near = sorted((abs(v - at), a, most) for h, a, at, most in anchors if h == g)
        if near and near[0][0] <= near[0][2]:
            want[p] = (near[0][1], near[0][0])
    assert got == want and want


def test_sharing_matches_all_pairs(spark):
    rng = random.Random(4)
    sets = {i: {0, *(rng.randrange(30) for _ in range(rng.randrange(9)))} for i in range(40)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "a int, item int")
    got = {(r.a, r.b): r.shared for r in stats.set_iou(df, "a", "item", 3).collect()}
    assert got == {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 3}


def chosen(x, count, share, rounds):
    """Plain version: all distances at once."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    centre = d[int(d.sum(1).argmin())]
    core = [i for i in range(len(x)) if centre[i] <= np.percentile(centre, share)]
    if len(core) < count:
        core = sorted(range(len(x)), key=lambda i: (centre[i], i))[:count]
    picked = [min(core, key=lambda i: (round(sum(d[i, j] for j in core), 9), i))]
    while len(picked) < min(count, len(core)):
        picked.append(min((i for i in core if i not in picked), key=lambda i: (-min(d[i, s] for s in picked), i)))
    for _ in range(rounds):
        own = {k: [i for i in core if min(range(len(picked)), key=lambda q: (d[i, picked[q]], q)) == k] for k in range(len(picked))}
        after = [min(own[k], key=lambda i: (round(sum(d[i, j] for j in own[k]), 9), i)) for k in range(len(picked))]
        if after == picked:
            break
        picked = after
    return picked


def test_variants_match_a_plain_version(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=(60, 6)), "b": rng.normal(size=(7, 6)), "c": rng.normal(size=(2, 6)), "d": rng.normal(size=(1, 6))}
    rows = [(g, i, x.tolist()) for g, m in groups.items() for i, x in enumerate(m)]
    got = {}
    for r in robust.variants(spark.createDataFrame(rows, "g string, k int, v array<double>"), "g", "k", "v").orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append(r.k)
    assert got == {g: chosen(m, 3, 55, 6) for g, m in groups.items()}


def test_splits_match_all_ways():
    rng = np.random.default_rng(6)
    for _ in range(20):
        span = int(rng.integers(6, 12))
        toll = np.append(rng.random(span), 0.0)
        expected = rng.uniform(0.5, 2.0, 3)
        want = np.maximum(expected / expected.sum() * span, 1)
        best = min((2 * sum((w / t - 1) ** 2 for w, t in zip((a, b - a, span - b), want, strict=True)) + toll[a] + toll[b], a, b) for a in range(1, span) for b in range(a + 1, span) if all(max(1, round(0.35 * t)) <= w <= max(1, round(2.6 * t)) for w, t in zip((a, b - a, span - b), want, strict=True)))
        bounds, price = K.split(0, span, expected, toll)
        assert abs(price * 3 - best[0]) < 1e-9 and bounds == [0, best[1], best[2], span]
    assert K.split_anyway(0, 2, np.array([1.0, 1.0, 1.0]), np.zeros(3))[1] == K.INFEASIBLE
    assert K.summits(np.array([1.0, 5, 5, 1, 4, 0, 0, 9]), 1, 2.0) == [1, 4, 7]


def test_sets_do_not_travel_with_pairs(spark):
    rng = random.Random(7)
    # pairs of owners are many and their sets large: a set beside each pair is what filled the disk
    df = spark.createDataFrame([(i, x) for i in range(30) for x in rng.sample(range(200), 60)], "a int, item int")
    plan = stats.set_iou(df, "a", "item", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "_items" not in plan


def test_sharing_with_frequent_items(spark, monkeypatch):
    rng = random.Random(8)
    sets = {f"o{i:02}": {0, 1, *(min(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(12)))} for i in range(40)}
    rows = [(i, x) for i, s in sets.items() for x in s for _ in range(rng.choice([1, 1, 3]))] + [(None, 1), (None, 2), ("o00", None), ("o00", None), ("lone", None)]
    df = spark.createDataFrame(rows, "a string, item int")
    size = {i: len(s) + (i == "o00") for i, s in sets.items()}  # an item without a value counts once in a set's size and is shared with none
    for frequent, sent, least in ((5, 500_000, 4), (5, 0, 3), (0, 500_000, 2), (5, 500_000, 1), (1024, 0, 4)):
        monkeypatch.setattr(match, "FREQUENT", frequent)
        monkeypatch.setattr(match, "MOST_SENT", sent)
        got = {(r.a, r.b): (r.shared, round(r.iou, 9)) for r in stats.set_iou(df, "a", "item", least).collect()}
        both = {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j}
        assert got == {p: (k, round(k / (size[p[0]] + size[p[1]] - k), 9)) for p, k in both.items() if k >= least}


def test_no_sets_share_nothing(spark):
    assert stats.set_iou(spark.createDataFrame([], "a int, item int"), "a", "item", 2).count() == 0
