"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest

import corpus_pipeline
from sparkglyph.llm import bpe, chat, chosen_path, compression, ctw, isolation, langid, licenses, mixing, pivots, queries

from .fixtures import EXTRA, SCHEMA, frame, labels, odd

LABELS = "doc_id long, quality int, toxic int"


def write(spark, path, docs, marks):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


TEXT_QUERIES = ["op1_quality_rules", "op2_quality_classifier", "op3_license_scan", "op4_language_id", "op6_lm_score", "op7_mix_sources", "op8_ngram_join", "op10_bpe"]


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    marks = [(4, 1, 0), (5, 0, 0), (8, None, 0), (None, 1, 1), (5, 0, 0)]
    return {
        "odd": write(spark, base / "odd", frame(spark, odd(), extra=True), marks),
        "empty": write(spark, base / "empty", spark.createDataFrame([], SCHEMA), []),
    }


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_odd_rows(spark, dirs, name):
    got = queries.QUERIES[name](spark, dirs["odd"]).toPandas()
    assert sorted(got.doc_id.fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in odd())
    twice = got[got.doc_id == 5].astype(str)
    if name != "op7_mix_sources":
        assert twice.iloc[0].tolist() == twice.iloc[1].tolist()
    if name == "op8_ngram_join":
        assert got.set_index("doc_id").n_links.loc[6] == 2 and got.set_index("doc_id").component_id.loc[6] == 5
    if name == "op4_language_id":
        assert (got[got.doc_id.isin([1, 3, 7, 9])].lang_pred == "und").all()
    if name == "op1_quality_rules":
        assert got[got.doc_id == 4].n_words.iloc[0] == 60_000 and got[got.doc_id == 1].base_failed.all()


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_empty_tables(spark, dirs, name):
    assert queries.QUERIES[name](spark, dirs["empty"]).count() == 0


def test_pipeline_on_odd_and_empty_rows(spark, dirs):
    docs = spark.read.parquet(dirs["odd"] + "/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, dirs["odd"])
        assert docs.columns == [*SCHEMA_COLUMNS, *EXTRA], name
    assert corpus_pipeline.run(spark, dirs["empty"]).count() == 0


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages_on_odd_rows_alone(spark):
    docs = frame(spark, odd(), extra=True)
    assert mixing.mix(docs).columns == docs.columns
    kept = chosen_path.dedupe(docs).collect()
    assert sum(r.doc_id in (5, 6) for r in kept) == 1
    assert sum(r.text in (None, "", "\t \n") for r in kept) == 3


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [1.0, float("nan"), 3.0]), (7, [float("inf"), 1.0, 1.0]), (8, []), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (11, [2.0, 4.0, 6.0]), (None, v)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 11: (2, 1), 9: (1, 9), 10: (1, 9), None: (0, None)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 8)}
    assert pivots.duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_conversations_with_nulls(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", None), (2, 5, "ro\\le\nx", "<|im_end|>")]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1, -1: 2}
    assert got[-1].loss_chars == 21 and got[None].loss_chars == 0
    assert {r.conv_id for r in chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()} == {-1}


def test_models_without_labels(spark):
    docs = frame(spark, odd())
    none = spark.createDataFrame([], LABELS)
    assert isolation.report(docs, none).where("excess > 0").count() == 0
    assert {round(r.s, 6) for r in docs.select(compression.score(compression.fit(docs, none), docs["text"]).alias("s")).collect()} == {0.5}
    model = langid.fit(docs.where("false"))
    assert {r.p.lang_pred for r in docs.select(langid.identify(model, docs["text"]).alias("p")).collect()} == {"und"}
    learnt = ctw.learn(docs.where("false"))
    assert learnt.total == 0 and learnt.distinct == 0


def test_labels_helper_marks_both_classes():
    from .fixtures import documents

    assert {m[1] for m in labels(documents())} == {0, 1}


def test_modules_have_docstrings_for_their_cases():
    for module in (bpe, chat, chosen_path, compression, ctw, isolation, langid, licenses, mixing, pivots):
        assert "Defined cases" in module.__doc__
