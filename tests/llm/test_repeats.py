"""Rows without ids and rows that repeat, in the mix, the vectors and the chat format."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sparkglyph.llm import chat, isolation, mixing, pivots

from .fixtures import documents, frame, labels


def test_mix_of_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    rows = [(None, "a few words here", "en", "x", 0)] * 700 + [(3, f"text {i}", "en", "x", i) for i in range(50)] + [(i, "one two three " * (i % 5), "en", "y", 0) for i in range(100, 300)]
    docs = frame(spark, rows).repartition(3)
    found = mixing.decide(docs).toPandas()
    assert len(found) == len(rows)
    assert sorted(found[found._id.isna()]._occ) == list(range(700))
    want = found._copies.sum()
    mixed = mixing.mix(docs).toPandas()
    assert len(mixed) == want
    assert (mixed.doc_id.isna()).sum() == found[found._id.isna()]._copies.sum()
    size = {"x": 700 * 4 + 100, "y": 40 * (0 + 3 + 6 + 9 + 12)}
    goal = dict(zip(size, mixing.targets(list(size.values()), [5.0, 2.0]), strict=True))
    mixed["words"] = mixed.text.str.split().map(len)
    for s, g in mixed.groupby("source"):
        assert abs(g.words.sum() - goal[s]) <= 0.02 * goal[s] + 4


def test_mix_against_a_plain_version(spark):
    """Sizes, sources' sizes, targets and limits by plain Python; totals of documents and words by expectation."""
    rows = documents(400, 7)
    got = {r.doc_id: r for r in mixing.report(frame(spark, rows).repartition(3)).collect()}
    size = {r[0]: len(r[1].split()) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r[0])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in by[s]) for s in names}
    weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))]
    left, target, free = 1.5 * sum(total.values()), {}, list(range(len(names)))
    while free:
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 2 * total[names[k]]]
        for k in over or free:
            target[names[k]] = 2.0 * total[names[k]] if over else share[k]
        if not over:
            break
        left -= sum(2.0 * total[names[k]] for k in over)
        free = [k for k in free if k not in over]
    for s in names:
        ratio = target[s] / total[s]
        assert all(abs(got[i].target - target[s]) < 1e-6 and got[i].source_size == total[s] and got[i].size == size[i] for i in by[s])
        assert all(got[i].taken in (int(ratio) * size[i], (int(ratio) + 1) * size[i]) for i in by[s])
        assert abs(sum(got[i].taken for i in by[s]) - target[s]) <= 0.01 * target[s] + 2
        assert abs(sum(got[i].copies for i in by[s]) - ratio * len(by[s])) < 4


def test_kept_rows_are_those_of_the_report(spark):
    rows = documents(200, 3) + [(None, "too few", None, None, 0), (900, None, None, None, None)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels(rows[:200]), "doc_id long, quality int, toxic int")
    want = sorted(str(r.doc_id) for r in isolation.report(docs, marks).where("kept").collect())
    assert sorted(str(r.doc_id) for r in isolation.keep(docs, marks).collect()) == want and len(want) > 50


def test_every_row_of_vectors_is_returned(spark):
    a, b = [1.0, 2.0, 3.0], [-1.0, 5.0, 0.0]
    rows = [(1, a)] * 3 + [(2, a), (None, b), (None, b), (4, b)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in pivots.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 0, 0, True)] * 2 + [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (4, 0, 4, True)]


def test_planted_vectors_at_full_pivots(spark):
    """Pairs at a cosine of just over 0.9 among vectors enough for more pivots than the least number."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12_000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(600, 64))
    side -= (side * base[:600]).sum(axis=1)[:, None] * base[:600]
    side /= np.linalg.norm(side, axis=1)[:, None]
    planted = 0.905 * base[:600] + np.sqrt(1 - 0.905**2) * side
    x = np.concatenate([base, planted]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.component_id for r in pivots.duplicates(df).collect()}
    assert len(got) == len(x)
    found = sum(got[12_000 + i] == got[i] for i in range(600))
    assert found >= 0.95 * 600, found
    assert sum(got[i] == i for i in range(12_000)) == 12_000


def test_roles_of_a_table_stay(spark):
    odd = ["human", "gpt", "a\\n\x00b", "\\\\n", "\\\n\\", "<|im_end|>"]
    rows = [(1, k, r, f"t{k}") for k, r in enumerate(odd)]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    plain = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert got[1].turns_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert got[1].loss_chars == 0 and got[-1].loss_chars == 21
    record = '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'
    turns = chat.canonical(spark.createDataFrame([(record,)], "record string")).select(F.transform("turns", lambda t: t["role"]).alias("r")).first().r
    assert turns == ["user", "assistant"]
