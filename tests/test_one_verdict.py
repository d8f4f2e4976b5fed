"""A paragraph's verdict and the members of a cell are computed once, whatever filters stand on them."""

from pyspark.sql import functions as F
from test_engine import corpus, rules

from tessera.functions.text import facet_values
from tessera.operators import evaluate, output, select


def test_filters_stay_above_the_verdict(spark):
    tokens, sentences = corpus(spark, {1: {11: ["a", "b"], 12: ["c"]}, 2: {21: ["b", "c"]}, 3: {31: ["a"]}})
    found = rules({"condition_id": "x", "categories": ["k"], "forms": ["a", "b"]}, {"condition_id": "y", "categories": ["l"], "forms": ["c"]})
    records = select.select_paragraphs(evaluate.Evaluation(found, tokens, sentences).build())
    chosen = output.facet_filter(records, {"matched_condition_ids_text": ["y"], "matched_categories_text": ["l"]})
    # the table of programs is looked up where the verdict is, and nowhere else
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    assert sorted(r.matched_condition_ids_text for r in chosen.collect()) == ["x, y", "y"]


def test_cells_are_split_once(spark):
    df = spark.createDataFrame([("a, b、a;",), ("",), (None,), (" ; ",)], "a string").select(facet_values(F.col("a")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.v for r in df.collect()] == [["a", "b"], [""], [""], [""]]
