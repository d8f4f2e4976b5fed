"""Rules over a stream of documents: paragraphs are matched as they arrive, row by row, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators.evaluate import literal, matched_categories, matched_ids, numbers, rule_columns, strings
from tessera.plans.ruledata import RuleData
from tessera.plans.rules import RuleSet


def match_paragraphs(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """Matched paragraphs of a (streaming or batch) documents frame.

    Rules must decide within one paragraph and without distances or references; others are an error, as they need the
    batch plan.
    """
    rows = ingest.paragraphs_frame(documents).select("paragraph_id", "document_id", F.col("paragraph_text").alias("paragraph_text"))
    for r in rules.rules:
        scopes = {g.search_scope for g in (*r.form_groups, *r.text_groups)} | {r.search_scope}
        if r.has_reference or r.annotation_filters or r.distance is not None or any(g.distance is not None for g in r.form_groups) or scopes != {"paragraph"}:
            raise ValueError(f"rule {r.id} can't be decided on one paragraph")
    data = RuleData(rules.rules)
    words = F.array_distinct(F.regexp_extract_all(F.lower("paragraph_text"), F.lit(ingest.TOKEN), F.lit(0)))
    known = literal(list(data.forms), "array<string>")
    forms = F.transform(F.array_intersect(words, known), lambda w: (F.array_position(known, w) - 1).cast("int"))
    rows = rows.withColumns({"forms": forms, "labels": strings(()), "near": numbers(), "counts": F.array().cast("array<struct<program:int,n:bigint>>")})
    rows = rule_columns(rows, data, F.col("paragraph_text"))
    rows = rows.withColumns({"ids": matched_ids(data, F.col("matched")), "categories": matched_categories(data, F.col("matched"))})
    needed = len(rules.rules) if rules.settings.condition_match_logic == "all" else 1
    return rows.where(F.size("ids") >= needed).select("paragraph_id", "document_id", "paragraph_text", F.array_join("ids", ", ").alias("matched_condition_ids_text"), F.array_join("categories", ", ").alias("matched_categories_text"))
