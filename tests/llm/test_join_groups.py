"""Large groups of near copies, many rows without an id, and planted pairs."""

import random

import numpy as np

from sparkglyph import staging
from sparkglyph.llm import chosen_path

from .fixtures import frame


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def brute(texts):
    """Links by one product of the whole incidence matrix."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    number = {}
    for s in sets:
        for g in s:
            number.setdefault(g, len(number))
    m = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[g] for g in s]] = 1
    inter, size = m @ m.T, m.sum(axis=1)
    hit = 5 * inter >= 4 * (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(hit, False)
    return hit


def test_near_copies_are_not_split(spark, monkeypatch):
    rng = random.Random(3)
    base, passage = words(rng, 90), words(rng, 30)
    texts = []
    for _ in range(2000):
        w = list(base)
        w[rng.randrange(90)] = words(rng, 1)[0]
        texts.append(" ".join(w))
    # a passage that many otherwise different texts share: their bucket must be split
    texts += [" ".join(words(rng, 60) + passage + words(rng, 60)) for _ in range(600)]
    hit = brute(texts)
    made = []
    stage = staging.stage

    def counted(df, name, files=None):
        out = stage(df, name, files)
        if name == "paths":
            made.append(out.count())
        return out

    monkeypatch.setattr(chosen_path.staging, "stage", counted)
    got = {r.doc_id: r for r in chosen_path.report(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]).repartition(4)).collect()}
    assert [got[i].n_links for i in range(len(texts))] == hit.sum(axis=1).tolist()
    assert all(got[i].component_id == 0 for i in range(2000)) and all(got[i].kept for i in range(2000, 2600))
    # only the texts of the passage go down a level: a few paths each
    assert sum(made) < 600 * 6 * 10


def test_many_rows_without_an_id(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, 12)) for _ in range(4000)]
    rows = [(None, t, None, str(i), None) for i, t in enumerate(texts)] + [(None, texts[7], None, "7", None)] * 1000 + [(5, texts[9], None, None, None), (6, texts[9], None, None, None)]
    docs = frame(spark, rows).repartition(4)
    found = chosen_path.report(docs).toPandas()
    assert len(found) == len(rows) and (found.n_links == 1000).sum() == 1001 and (found.n_links == 2).sum() == 3
    kept = chosen_path.dedupe(docs).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    assert [r.doc_id for r in kept if r.text == texts[9]] == [5]


def test_many_texts_of_one_id(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, 12)) for _ in range(500)]
    kept = chosen_path.dedupe(frame(spark, [(1, t, None, None, None) for t in texts * 2])).collect()
    assert sorted(r.text for r in kept) == sorted(texts)


def test_planted_pairs_are_found(spark):
    """Recall at the border: pairs at 0.8 to 0.85, hidden in a common passage's bucket."""
    rng = random.Random(6)
    passage, texts = words(rng, 20), []
    for _ in range(400):
        w = words(rng, 100) + passage
        texts.append(" ".join(w))
        for k in (20, 60):
            w[k] = words(rng, 1)[0]
        texts.append(" ".join(w))
    hit = brute(texts)
    assert hit.sum() == 800
    got = {r.doc_id: r.n_links for r in chosen_path.report(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert sum(got.values()) >= 0.99 * hit.sum()
    assert all(got[i] <= hit[i].sum() for i in got)


def test_few_sets_go_down_several_levels_at_once(spark, monkeypatch):
    """A passage of a third of each text: its buckets stay large for many levels, which are not a round of jobs each."""
    rng = random.Random(9)
    passage, texts = words(rng, 50), [" ".join(words(rng, 120)) for _ in range(1500)]
    for i in range(200):
        w = words(rng, 75) + passage
        texts.append(" ".join(w))
        if i % 4 == 0:
            w[30] = words(rng, 1)[0]
            texts.append(" ".join(w))
    hit, rounds, stage = brute(texts), [], staging.stage

    def counted(df, name, files=None):
        out = stage(df, name, files)
        if name == "paths":
            rounds.append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "BUCKET", 100)
    monkeypatch.setattr(chosen_path.staging, "stage", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in chosen_path.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == hit.sum(axis=1).tolist() and hit.sum() == 100
    assert 0 < len(rounds) <= 3, rounds
    assert chosen_path.levels_for(10, 1, 100) == 2 and chosen_path.levels_for(10**6, 1, 10) == 1 and chosen_path.levels_for(1, 6, 10**9) == 2
