"""Languages of few labelled documents."""

from sparkglyph.llm import langid


def test_every_language_keeps_a_document_to_learn_from(spark):
    rows = [(i, f"l{i}", "some text") for i in range(40)] + [(100 + i, "many", "some text") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = langid.sample(docs, "lang", "doc_id", "text", 1500, 5).collect()
    assert {r._lang for r in got if not r._aside} == {r[1] for r in rows}
    assert any(r._aside for r in got) and len(got) == len(rows)
