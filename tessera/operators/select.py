"""Selection of paragraphs or sentences by a rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evaluate import NUMBERS, Evaluation, false_if_null, let, literal, matched_categories, matched_ids, numbers


def enough(matched: Column, evaluation: Evaluation) -> Column:
    rules = evaluation.rule_set
    return matched >= (len(rules.rules) if rules.settings.condition_match_logic == "all" else 1)


def select_paragraphs(evaluation: Evaluation) -> DataFrame:
    """Matched paragraphs with their rule ids and categories, at most as many as the settings allow.

    Those with most matched rules stay, of equals the ones with the smaller id.
    """
    data, matched = evaluation.data, F.col("matched")
    rows = evaluation.paragraph_rows.select("paragraph_id", matched_ids(data, matched).alias("condition_ids"), matched_categories(data, matched).alias("categories"), "sentence_count", F.size(matched).cast("long").alias("matched_condition_count"))
    rows = rows.where(enough(F.col("matched_condition_count"), evaluation) & (F.col("matched_condition_count") > 0))
    return top(rows, evaluation.rule_set.settings.max_reconstructed_paragraphs).select(
        "paragraph_id", "sentence_count", "matched_condition_count", F.array_join("condition_ids", ", ").alias("matched_condition_ids_text"), F.array_join("categories", ", ").alias("matched_categories_text")
    )


#: A cap from here on is none.
UNCAPPED = 2**31 - 1


def top(rows: DataFrame, most: int) -> DataFrame:
    return rows if most >= UNCAPPED else rows.orderBy(F.col("matched_condition_count").desc(), "paragraph_id").limit(most)


class SentenceSelection:
    """Sentence mode: ``truth``, the numbers of the rules that hold in each sentence.

    Rules that decide by sentence need a hit there: a positive group of them must hold in the sentence, so that the not
    side of an or alone is no match. Rules that decide by paragraph hold in all its sentences. Text groups add to
    that; annotation filters count through the paragraph's verdict. References to categories look at the paragraph,
    references to rules at the sentence or paragraph by the rule's scope; rules that refer to each other go layer by
    layer, and each layer looks once at the sentences of the whole paragraph.
    """

    def __init__(self, evaluation: Evaluation, all_tokens: DataFrame):
        self.e = e = evaluation
        rows = e.sentence_rows.join(e.paragraph_rows.select("paragraph_id", "parted", "base"), "paragraph_id")
        displayed = all_tokens.select("paragraph_id", "sentence_id").distinct().withColumn("has_display_tokens", F.lit(True))
        rows = rows.join(displayed, ["paragraph_id", "sentence_id"], "left").withColumn("has_display_tokens", false_if_null(F.col("has_display_tokens")))
        rows = rows.withColumn("own", self._own()).drop("parted", "base", "held", "forms")
        rows = rows.withColumn("truth", F.array_union(F.array_intersect("own", numbers(e.data.free())), numbers(e.data.unbound())))
        for layer in e.data.layers():
            around = F.collect_list("truth").over(Window.partitionBy("paragraph_id"))
            rows = rows.withColumn("around", F.array_distinct(F.flatten(around))).withColumn("truth", F.concat("truth", self._bound(layer))).drop("around")
        self.rows = rows.drop("own")

    def _own(self) -> Column:
        """Rules that hold in the sentence as far as they themselves go."""
        table = literal(self.e.data.by_sentence(), f"array<struct<whole:boolean,programs:{NUMBERS},touch:{NUMBERS},based:boolean,never:boolean>>")

        def holds(u: Column, n: Column) -> Column:
            r, base = F.get(table, n), F.array_contains(u["base"], n)
            here = F.forall(r["programs"], lambda p: F.array_contains(u["held"], p)) & ((F.size(r["touch"]) == 0) | F.arrays_overlap(u["forms"], r["touch"]))
            return F.when(r["whole"], base).otherwise(here & ~r["never"] & (~r["based"] | base))

        return let(F.struct("base", "held", "forms", "parted"), lambda u: F.filter(u["parted"], lambda n: holds(u, n)))

    def _bound(self, layer: list[int]) -> Column:
        """Rules of a layer whose references hold."""
        data = self.e.data

        def split(ids: list[int], categories: list[int], negate: bool) -> dict:
            here = [k for k in ids if data.mode_scope(data.rules[k]) == "sentence"]
            return {"here": here, "around": [k for k in ids if k not in here] + categories, "negate": negate}

        table = literal([{"rule": k, "based": data.rules[k].has_base, "tests": [split(*t) for t in data.tests(k)]} for k in layer], f"array<struct<rule:int,based:boolean,tests:array<struct<here:{NUMBERS},around:{NUMBERS},negate:boolean>>>>")

        def holds(u: Column, r: Column) -> Column:
            return (~r["based"] | F.array_contains(u["own"], r["rule"])) & F.forall(r["tests"], lambda t: (F.arrays_overlap(u["truth"], t["here"]) | F.arrays_overlap(u["around"], t["around"])) != t["negate"])

        return let(F.struct("own", "truth", "around"), lambda u: F.transform(F.filter(table, lambda r: holds(u, r)), lambda r: r["rule"]))

    def sentences(self) -> DataFrame:
        """Selected sentences that can be displayed, of the paragraphs that the cap leaves."""
        data, truth = self.e.data, F.col("truth")
        rows = self.rows.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "has_display_tokens", matched_ids(data, truth).alias("condition_ids"), matched_categories(data, truth).alias("categories"))
        rows = rows.withColumn("matched_condition_count", F.size("condition_ids").cast("long"))
        per = rows.groupBy("paragraph_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("condition_ids")))).cast("long").alias("matched_condition_count"))
        kept = top(per.where(enough(F.col("matched_condition_count"), self.e) & (F.col("matched_condition_count") > 0)), self.e.rule_set.settings.max_reconstructed_paragraphs)
        rows = rows.where(enough(F.col("matched_condition_count"), self.e) & (F.col("matched_condition_count") > 0) & F.col("has_display_tokens"))
        return rows.join(kept.select("paragraph_id"), "paragraph_id", "left_semi").select(
            "paragraph_id", "sentence_id", "sentence_no_in_paragraph", "matched_condition_count", F.array_join("condition_ids", ", ").alias("matched_condition_ids_text"), F.array_join("categories", ", ").alias("matched_categories_text")
        )


# ---------------------------------------------------------------- summaries of both grains
def detail_summary(condition_eval: DataFrame, truth: DataFrame, categories: dict[str, tuple[str, ...]], every: bool = False) -> DataFrame:
    """Paragraphs' summary from the truth of their sentences.

    A rule is matched in a paragraph if ``truth`` (paragraph_id, condition_id; any number of rows) has it there, whatever the
    paragraph's own verdict in ``condition_eval`` is. Returns ``paragraph_id, condition_count, matched_condition_count,
    is_selected, matched_condition_ids_text, matched_categories_text``; with ``every`` all rules have to match.
    """
    found = truth.select("paragraph_id", "condition_id").distinct().withColumn("found", F.lit(True))
    rows = condition_eval.select("paragraph_id", "condition_id").join(found, ["paragraph_id", "condition_id"], "left")
    ids = F.array_sort(F.collect_set(F.when(F.col("found"), F.col("condition_id"))))
    per = rows.groupBy("paragraph_id").agg(F.count(F.lit(1)).alias("condition_count"), ids.alias("ids"))
    table = literal({k: list(v) for k, v in categories.items()}, "map<string,array<string>>")
    matched = F.size("ids").cast("long")
    return per.select(
        "paragraph_id", "condition_count", matched.alias("matched_condition_count"), (matched >= (F.col("condition_count") if every else F.lit(1))).alias("is_selected"), F.array_join("ids", ", ").alias("matched_condition_ids_text"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("ids", lambda i: F.coalesce(F.try_element_at(table, i), F.array().cast("array<string>")))))), ", ").alias("matched_categories_text"),
    )


#: What a summary has in each grain.
SUMMARY = ["condition_count", "is_selected", "condition_ids", "categories"]


def inherited(sentences: DataFrame, sentence_summary: DataFrame, paragraph_summary: DataFrame) -> DataFrame:
    """Sentences' summaries with what their paragraphs matched.

    ``sentences`` (sentence_id, paragraph_id) are all there are; summaries have the columns of ``SUMMARY`` (ids and categories
    as arrays). Counts of rules add up, ids and categories unite in order, and a sentence that has no summary takes
    its paragraph's selection; without either it has nothing and isn't selected.
    """
    own = sentence_summary.select("sentence_id", F.struct(*SUMMARY).alias("s"))
    above = paragraph_summary.select("paragraph_id", F.struct(*SUMMARY).alias("p"))
    rows = sentences.select("sentence_id", "paragraph_id").distinct().join(own, "sentence_id", "left").join(above, "paragraph_id", "left")
    none = F.array().cast("array<string>")

    def united(c: str) -> Column:
        return F.array_sort(F.array_union(F.coalesce(F.col("s")[c], none), F.coalesce(F.col("p")[c], none)))

    rows = rows.withColumns({"ids": united("condition_ids"), "all_categories": united("categories")})
    return rows.select(
        "sentence_id", "paragraph_id", (F.coalesce("s.condition_count", F.lit(0)) + F.coalesce("p.condition_count", F.lit(0))).cast("long").alias("condition_count"), F.size("ids").cast("long").alias("matched_condition_count"),
        F.coalesce("s.is_selected", "p.is_selected", F.lit(False)).alias("is_selected"), F.array_join("ids", ", ").alias("matched_condition_ids_text"), F.array_join("all_categories", ", ").alias("matched_categories_text"),
    )


def overwritten(rows: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values of ``details`` (a row per key at most) where it has one; columns that only it has are added."""
    both = [c for c in details.columns if c != key]
    packed = details.select(F.col(key).alias("__key"), F.struct(*both).alias("__new"))
    joined = rows.join(packed, rows[key] == F.col("__key"), "left")
    return joined.select(*((F.coalesce(F.col("__new")[c], F.col(c)).alias(c) if c in both else F.col(c)) for c in rows.columns), *(F.col("__new")[c].alias(c) for c in both if c not in rows.columns))
