"""A session whose tokens follow from its sentences never makes rows of all tokens."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.plans.catalog import condition, runtime
from tessera.session import Session


@pytest.mark.parametrize("unit", ["sentence", "paragraph"])
def test_lists_stand_for_tokens(spark, unit):
    docs = spark.createDataFrame([(1, "The cat of x. A dog.\nNo one, the end! of", "a", "b"), (2, "and nothing. ... of\n? the", None, "c"), (3, None, "a", "b")], "doc_id long, text string, source string, lang string")
    documents = ingest.documents_frame(docs)
    sentences = ingest.numbered_sentences(documents, ingest.TOKEN)
    paragraphs = sentences.where("sentence_no_in_paragraph = 1").select("paragraph_id", "document_id", "paragraph_no", "is_table_paragraph")
    tokens = ingest.tokens_of_sentences(sentences)
    rules = runtime(condition("s", ["c"], forms=["the", "of"], overall_search_scope="sentence"), condition("p", ["q"], forms=["and"]), condition("t", ["q"], forms=["dog"]), analysis_unit=unit)
    want = Session(tokens, sentences, paragraphs, documents).analyze(rules).export.collect()
    never = tokens.withColumn("surface", F.raise_error(F.lit("rows of all tokens were made")).cast("string")).withColumn("token_no", F.raise_error(F.lit("rows of all tokens were made")).cast("long"))
    got = Session(never, sentences, paragraphs.drop("is_table_paragraph"), documents, lists=ingest.token_lists(sentences), tokens_of=lambda forms: ingest.tokens_of_sentences(sentences, forms)).analyze(rules).export.collect()
    assert len(want) >= 2 and sorted(got) == sorted(want)
