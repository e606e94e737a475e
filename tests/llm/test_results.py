"""Operators against plain Python: brute force, exact round trips, held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkglyph.llm import bpe, chat, chosen_path, components, compression, ctw, isolation, langid, licenses, mixing, pivots
from sparkglyph.llm.text import remainder

from .fixtures import WORD, documents, frame, labels, prose


@pytest.fixture(scope="module")
def rows():
    return documents(240)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def marks(spark, rows):
    return spark.createDataFrame(labels(rows), "doc_id long, quality int, toxic int").cache()


def test_rule_counts_match_brute_force(docs, rows):
    found = {r._id: r for r in isolation.narrow(docs).collect()}
    for doc_id, text, *_ in rows:
        words = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        r = found[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered))


def test_rules_keep_good_and_reject_junk(docs, marks, rows):
    kept = {r.doc_id: r.kept for r in isolation.report(docs, marks).collect()}
    assert all(kept[r[0]] == ("***" not in r[1]) for r in rows)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 1)), [[30.0]]])
    s = isolation.Forest.grow(x, 60, 256, 1).score(x)
    assert s[-1] > 0.7 > np.quantile(s[:-1], 0.99)


def test_compression_tells_classes_apart(docs, marks, rows):
    model = compression.fit(docs, marks.where(remainder("doc_id", 5) != 0))
    found = {r.doc_id: r.s for r in docs.select("doc_id", compression.score(model, docs["text"]).alias("s")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(found[r[0]] >= 0.5) == ("***" not in r[1]) for r in held]) > 0.9


def test_licences_found_and_clean_text_left_alone(spark):
    rng = random.Random(5)
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "": "A license to think about the work and the public version of all terms."}
    data = [(i, prose(rng, 40) + "\n" + lines[k] + "\n" + prose(rng, 20), "en", k, 0) for i, k in enumerate(list(lines) * 10)]
    got = {r.doc_id: r.licenses for r in licenses.report(frame(spark, data)).collect()}
    assert all(got[d[0]] == d[3] for d in data)


def kneser_ney(texts, order):
    """Plain interpolated Kneser-Ney over padded strings, for comparison."""
    full = collections.Counter()
    for t in texts:
        padded = " " * order + t
        for i in range(order, len(padded)):
            full[padded[i - order + 1 : i + 1]] += 1
    levels = {order: full}
    for m in range(order - 1, 0, -1):
        # distinct left neighbours among the n-grams one longer
        levels[m] = collections.Counter(g[-m:] for g in {g[-(m + 1) :] for g in full})
    alphabet = len({c for g in full for c in g}) + 1

    def p(context, char, m=order):
        if m == 0:
            return 1 / alphabet
        c = levels[m]
        own = context[len(context) - m + 1 :] if m > 1 else ""
        mass = sum(n for g, n in c.items() if g[:-1] == own)
        below = p(context, char, m - 1)
        if not mass:
            return below
        one, two = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = one / (one + 2 * two) if one and two else 0.5
        kinds = sum(g[:-1] == own for g in c)
        return max(c.get(own + char, 0) - d, 0) / mass + d * kinds / mass * below

    return p


def test_kneser_ney_matches_the_formula():
    train, test = ["abab cabba abc", "bacca abba"], "abba zac cab"
    counts = langid.count_grams(pa.array(train))
    model = langid.Model.learn({"x": counts})
    p = kneser_ney([f"{t} " for t in train], langid.ORDER)
    chars, starts, _ = langid.letters(pa.array([test]))
    got = model.positions(chars, starts)[:, 0]
    padded = " " * langid.ORDER + "".join(map(chr, chars))
    want = [math.log(p(padded[i - langid.ORDER + 1 : i], padded[i])) for i in range(langid.ORDER, len(padded))]
    assert np.allclose(got, want, atol=1e-5)


def test_language_held_out_accuracy(docs, rows):
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0))
    got = {r.doc_id: r.p.lang_pred for r in docs.select("doc_id", langid.identify(model, docs["text"]).alias("p")).collect()}
    # copies of another document have its language
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 10 < 8]
    assert np.mean([got[r[0]] == r[2] for r in held]) > 0.95


def test_pivot_index_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 32))
    x[100:160] = x[100] + rng.normal(size=(60, 32)) * 0.08
    x[200:210] = x[200]
    x[300:340:2] = x[301:341:2] + rng.normal(size=(20, 32)) * 0.2
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    component = list(range(len(x)))
    for _ in range(len(x)):
        after = [min([component[i], *(component[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(x))]
        if after == component:
            break
        component = after
    recall = sum(v[0] for v in got.values()) / hit.sum()
    assert recall >= 0.9
    assert all(got[i][0] <= hit[i].sum() for i in got)
    assert got == {i: (int(hit[i].sum()), component[i], component[i] == i) for i in range(len(x))}


def naive_ctw(training, text, depth):
    """Bit-by-bit context-tree weighting with counts in dictionaries."""
    def strings(t):
        data = bytes([255] * depth) + t.lower().encode() + b"\xff"
        return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]

    nodes = [collections.defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    for t in training:
        for ctx, c in strings(t):
            for bit in range(8):
                for d in range(depth + 1):
                    nodes[d][ctx[depth - d :], (c | 256) >> (8 - bit)][c >> (7 - bit) & 1] += 1
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, stop = [{} for _ in nodes], [{} for _ in nodes]
    for d in range(depth, -1, -1):
        below = collections.defaultdict(float)
        if d < depth:
            for (ctx, p), w in weighted[d + 1].items():
                below[ctx[1:], p] += w
        for key, (a, b) in nodes[d].items():
            e = own(a, b)
            weighted[d][key] = e if d == depth else np.logaddexp(e, below[key]) - math.log(2)
            stop[d][key] = 1.0 if d == depth else math.exp(e - math.log(2) - weighted[d][key])
    total = 0.0
    for ctx, c in strings(text):
        for bit in range(8):
            p, rest = 0.0, 1.0
            for d in range(depth + 1):
                key = ctx[depth - d :], (c | 256) >> (8 - bit)
                if key not in nodes[d]:
                    p += rest * 0.5
                    break
                a, b = nodes[d][key]
                p += rest * stop[d][key] * (b + 0.5) / (a + b + 1)
                rest *= 1 - stop[d][key]
            total += math.log10(p if c >> (7 - bit) & 1 else 1 - p)
    return total


def test_context_tree_matches_plain_python(spark):
    training = ["the cat sat on the mat", "a cat and a hat", "The end.\nof it", ""]
    tests = ["the hat sat", "zebra", "", "Ünï cat"]
    df = spark.createDataFrame([(t,) for t in training], "text string")
    learnt = ctw.learn(df, depth=3)
    got = [sum(learnt.model.tree.score(ctw.strings(*ctw.B.closed(pa.array([t])), 3))) for t in tests]
    assert np.allclose(got, [naive_ctw(training, t, 3) for t in tests], rtol=1e-4)


@pytest.mark.parametrize("most_words", [1_000_000, 10])
def test_word_base_matches_brute_force(docs, rows, most_words):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    learnt = ctw.learn(docs.where(remainder("doc_id", 7) != 2), most_words=most_words)
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in ctw.score(docs, learnt, {"doc_id": F.col("doc_id")}).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r[0]: WORD.findall(r[1].translate(low)) for r in rows}
    count = collections.Counter(w for i, ws in words.items() if not held(i) for w in ws)
    ends = sum(not held(i) for i in words)
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, ws in words.items():
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in ws), ends])
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)


def test_targets_share_out():
    got = mixing.targets([100, 100, 100], [5, 2, 1])
    assert sum(got) == pytest.approx(450) and all(g <= 200 + 1e-9 for g in got) and got[0] == 200
    assert got[1] == pytest.approx(250 * 2 / 3) and got[2] == pytest.approx(250 / 3)


def test_mix_comes_near_the_targets_and_repeats(docs, rows):
    got = mixing.report(docs).toPandas()
    assert len(got) == len(rows)
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    assert all(size[r.doc_id] == r.size and r.taken <= 2 * r.size for r in got.itertuples())
    source = {r[0]: r[3] for r in rows}
    for _, g in got.groupby(got.doc_id.map(lambda i: source[i] or "~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.02 * g.target.iloc[0] + 2
    again = mixing.report(docs.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_blocks_keep_both_totals(docs):
    found = mixing.decide(docs, block=20).toPandas()
    by = found.groupby(found["_source"].fillna("~")).agg(c=("_copies", "sum"), n=("_copies", "size"), t=("_target", "first"), s=("_source_size", "first"))
    assert (abs(by.c - by.n * by.t / by.s) < 3).all()


def jaccard_links(rows):
    sets = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    return links


def test_chosen_path_matches_brute_force(docs, rows, monkeypatch):
    links = jaccard_links(rows)
    for bucket, block in ((256, 512), (2, 2)):  # the second splits all buckets and blocks
        monkeypatch.setattr(chosen_path, "BUCKET", bucket)
        monkeypatch.setattr(chosen_path, "BLOCK", block)
        got = {r.doc_id: r for r in chosen_path.report(docs).collect()}
        assert {i: r.n_links for i, r in got.items()} == {r[0]: len(links[r[0]]) for r in rows}
        assert all(got[i].component_id == got[j].component_id for i in links for j in links[i])
        assert all(got[i].component_id <= i for i in got)


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_chat_reads_layouts_and_round_trips(spark):
    tricky = "<|im_end|>\n</s> <\\s> [INST] [\\INST] \\ <|im_start|>user\n[[INST]"
    import json

    records = [
        {"messages": [{"role": "user", "content": tricky}, {"role": "assistant", "content": tricky}]},
        {"prompt": "p", "response": tricky},
        {"instruction": "i", "input": "", "output": "o"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
        {"question": "q", "answer": "a", "meta": {"x": [1, 2]}},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,), ('{"other": 1}',)], "record string")
    from pyspark.sql import functions as F

    out = chat.chat(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert [r.mapping for r in out] == ["messages", "prompt_response", "instruction", "conversations", "question_answer", None, None, None]
    assert all(r.back == r.turns for r in out)
    assert [t.text for t in out[0].turns] == [tricky, tricky]
    for r in out[:5]:
        assert [chat_unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss] == [t.text for t in r.turns if t.role == "assistant"]
        assert r.formatted.count("<|im_end|>") == len(r.turns)
    assert len({r.fingerprint for r in out[:5]}) == 5


def chat_unescape(s):
    return re.sub(rf"([<\[])\\(\\*)(?={chat.CONTROLS})", r"\1\2", s)


def test_bpe_is_exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = bpe.Bpe(open(path).read()), Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["", "<|endoftext|>a <|endoftext|>", "a" * 500, "éàü漢字 😀\x85\x1c 　x", "I'll don't 12345 ½", *(prose(rng, 50) for _ in range(20))]
    texts += ["".join(rng.choice(" etaoins'\n\t0é😀") for _ in range(60)) for _ in range(300)]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text) == want.ids
        assert ours.decode(want.ids) == theirs.decode(want.ids, skip_special_tokens=False)


def test_bpe_columns(spark):
    import public_tokenizers

    tok = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    got = df.select(tok.encode(df["text"]).alias("ids"), tok.decode(tok.encode(df["text"])).alias("back"), tok.digest(df["text"]).alias("d")).collect()
    assert [r.back for r in got] == ["hello world", "", ""]
    assert all(r.d.n_tokens == len(r.ids) and r.d.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)
