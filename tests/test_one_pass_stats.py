"""Counters of plain documents from one look at the texts."""

from tessera.operators import ingest


def test_texts_are_split_once_for_all_counters(spark):
    texts = ["One two. Two!\nthree ONE", "", None, " \n ", "...", "a.\n\nb? . c。d\n! !", "x (y. z) w"]
    raw = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    documents = ingest.documents_frame(raw)
    paragraphs = ingest.paragraphs_frame(documents)
    sentences = ingest.sentences_frame(paragraphs)
    want = dict(ingest.corpus_stats(documents, paragraphs, sentences, ingest.tokens_frame(sentences)).collect())
    got = ingest.plain_corpus_stats(documents)
    assert dict(got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(filter(") == 1  # paragraphs, once
    none = ingest.plain_corpus_stats(documents.where("false"))
    assert set(dict(none.collect()).values()) == {0} and len(none.collect()) == len(want)
