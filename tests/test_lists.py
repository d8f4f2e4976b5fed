"""Sentences with their tokens in one list: the same results as of token rows, without their exchanges."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import WHITE, uni_trim
from tessera.operators import hits, ingest, positions, render
from tessera.plans import catalog
from tessera.plans.config import compile_runtime

TEXTS = ["The cat. Of the dog!\nOf of the", "", "  a  \n\n the of. <of> \"the\"\n", "x? the, of the", "...", "no hit here"]


@pytest.fixture(scope="module")
def documents(spark):
    return ingest.documents_frame(spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, lang string"))


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_white_space_is_all_that_java_trims(spark):
    every = "".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(c + "a" + c,) for c in every], "t string")
    assert df.where(uni_trim(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert len(WHITE) == 25


def test_tokens_of_kept_sentences_are_those_of_the_texts(documents):
    sentences = ingest.numbered_sentences(documents, ingest.TOKEN)
    want = ingest.positioned_tokens(ingest.paragraphs_frame(documents)).select(positions.COLUMNS)
    found = ingest.tokens_of_sentences(sentences).select(positions.COLUMNS)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    few = ingest.tokens_of_sentences(sentences, ["of", "cat"]).select(positions.COLUMNS)
    assert sorted(map(str, few.collect())) == sorted(map(str, want.where("normalized_form in ('of', 'cat')").collect()))
    assert exchanges(found) == 0


def test_lists_render_as_rows_do(documents):
    sentences = ingest.numbered_sentences(documents, ingest.TOKEN)
    tokens, lists = ingest.tokens_of_sentences(sentences), ingest.token_lists(sentences)
    rules = compile_runtime({"cooccurrence_conditions": [{"condition_id": "a", "categories": ["x"], "forms": ["the", "of"], "form_match_logic": "any"}, {"condition_id": "b", "categories": ["y"], "forms": ["of"]}]})
    marked = render.token_annotations(hits.locate(tokens, rules).rows)
    for f in (render.rendered_sentences, render.rendered_paragraphs):
        a, b = f(lists, marked), f(tokens, marked)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    # numbers with gaps and rows out of order are found by their numbers
    gaps = tokens.withColumn("token_no", F.col("token_no") * 3 + 2)
    spaced = marked.withColumn("token_no", F.col("token_no") * 3 + 2)
    texts = ["sentence_id", "sentence_text_tagged", "sentence_text_html", "annotated_token_count"]
    assert sorted(map(str, render.rendered_sentences(gaps.orderBy(F.desc("token_no")), spaced).select(texts).collect())) == sorted(map(str, render.rendered_sentences(lists, marked).select(texts).collect()))


def test_tokens_without_hits_are_not_exchanged(spark):
    c = catalog.Corpus(spark, "/root/testdata/sf0.001")
    assert "tokens_before" in c.sentences.columns and exchanges(c.tokens) == 0
    for q in (catalog.sentences_rebuilt, catalog.lossless_tokens):
        assert exchanges(q(spark, "/root/testdata/sf0.001")) == 0
