"""Rules that look at sentences don't put paragraphs together."""

from tessera.plans import catalog


def test_sentence_texts_need_no_paragraph_text(spark):
    def plan(name):
        return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

    assert "paragraph_text" not in plan("text_not") and "paragraph_text" not in plan("text_all")
    assert "paragraph_text" in plan("text_any")
