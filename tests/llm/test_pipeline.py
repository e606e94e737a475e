"""The chain of stages against plain Python over the same rows."""

import collections
import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkglyph.llm import mixing

from .fixtures import WORD, documents, frame, labels
from .test_results import jaccard_links


def test_stages_match_plain_python(spark, tmp_path):
    rows = documents(160) + [(900, "¿¿ 12 -- !!", "en", "s0", 11), (901, "жжж ыыы щщщ ъъъ эээ юююю яяяя ффф ццц ччч шшш " * 3, None, "s1", 120)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels(rows), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # languages: the two odd texts go; rules: junk goes; join: the least id of each group stays
    kept = [r for r in rows if r[0] < 900 and "***" not in r[1]]
    links = jaccard_links(kept)
    group = {r[0]: r[0] for r in kept}
    for _ in kept:
        for i in group:
            group[i] = min([group[i], *(group[j] for j in links[i])])
    kept = [r for r in kept if group[r[0]] == r[0]]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in kept}
    assert {r.doc_id for r in out} <= set(text)
    size = {i: len(WORD.findall(t)) for i, t in text.items()}
    by = collections.defaultdict(int)
    for r in kept:
        by[r[3]] += size[r[0]]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([by[n] for n in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))]), strict=True))
    taken = collections.Counter()
    source = {r[0]: r[3] for r in kept}
    for r in out:
        taken[source[r.doc_id]] += size[r.doc_id]
    for n in names:
        assert taken[n] == pytest.approx(goal[n], rel=0.02, abs=3)
    assert max(collections.Counter(r.doc_id for r in out).values()) <= 2
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert out and len(corpus_pipeline.STAGES) == 5
