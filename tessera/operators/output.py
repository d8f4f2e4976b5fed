"""Annotation summaries, enrichment, export frames, facets and neighbour lookup."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import facet_values, uni_trim

#: Columns of the exports, in order.
MATCH = ["matched_condition_ids_text", "matched_categories_text", "matched_form_group_ids_text", "matched_form_group_logics_text", "form_group_explanations_text", "text_groups_explanations_text", "mixed_scope_warning_text", "match_group_ids_text", "match_group_count", "annotated_token_count"]
MANUAL = ["manual_annotation_count", "manual_annotation_pairs_text", "manual_annotation_namespaces_text"]
PARAGRAPH_COLUMNS = ["paragraph_id", "document_id", "category1", "category2", "sentence_count", "paragraph_text", "paragraph_text_tagged", "paragraph_text_highlight_html", *MATCH, *MANUAL]
SENTENCE_COLUMNS = ["sentence_id", "paragraph_id", "document_id", "category1", "category2", "sentence_no_in_paragraph", "sentence_no_in_document", "sentence_text", "sentence_text_tagged", "sentence_text_highlight_html", *MATCH]
NUMERIC_FACETS = ("paragraph_id", "document_id", "sentence_count", "match_group_count", "annotated_token_count", "sentence_id", "group_count")
FACETS = {"paragraph_id": False, "document_id": False, "category1": False, "category2": False, "sentence_count": False, "matched_categories_text": True, "matched_condition_ids_text": True, "match_group_ids_text": True, "match_group_count": False, "annotated_token_count": False}


# ---------------------------------------------------------------- annotations
def annotation_pairs(annotations: DataFrame) -> DataFrame:
    """``paragraph_id, annotation_pair, label_namespace``, each once."""
    pair = F.concat("label_namespace", F.lit(":"), "label_key", F.lit("="), "label_value")
    return annotations.select("paragraph_id", "label_namespace", "label_key", "label_value").distinct().select("paragraph_id", "label_namespace", pair.alias("annotation_pair"))


def annotation_summary(annotations: DataFrame) -> DataFrame:
    pairs = annotation_pairs(annotations)
    return pairs.groupBy("paragraph_id").agg(
        F.count(F.lit(1)).alias("manual_annotation_count"), F.array_join(F.array_sort(F.collect_list("annotation_pair")), "\n").alias("manual_annotation_pairs_text"), F.array_join(F.array_sort(F.collect_set("label_namespace")), ", ").alias("manual_annotation_namespaces_text")
    )


def annotation_issues(annotations: DataFrame) -> DataFrame:
    """Rows that repeat, and keys with several values."""
    keys = ["paragraph_id", "label_namespace", "label_key"]
    twice = annotations.groupBy(*keys, "label_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("annotation_duplicate_deduplicated").alias("code"), *keys, F.col("label_value").alias("values_text"), "n")
    values = annotations.groupBy(*keys).agg(F.array_sort(F.collect_set("label_value")).alias("v")).where(F.size("v") > 1)
    return twice.unionByName(values.select(F.lit("annotation_value_conflict").alias("code"), *keys, F.array_join("v", ", ").alias("values_text"), F.size("v").cast("long").alias("n")))


def add_annotation(records: DataFrame, paragraph_id: int, namespace: str, key: str, value: str) -> DataFrame:
    """Result records after one more annotation of a paragraph: count, pairs and namespaces follow without a new summary.

    The pair is appended on a line of its own; namespaces stay sorted, each once. All three columns are texts in a
    result file, and stay what they are; a count that is no number counts as 0.
    """
    here = F.col("paragraph_id").cast("string") == str(paragraph_id)
    pair, space = f"{namespace.strip()}:{key.strip()}={value.strip()}", namespace.strip()
    pairs = uni_trim(F.coalesce(F.col("manual_annotation_pairs_text"), F.lit("")))
    spaces = F.filter(F.transform(F.split(F.coalesce("manual_annotation_namespaces_text", F.lit("")), ","), uni_trim), lambda v: v != "")
    spaces = F.array_join(F.array_sort(F.array_union(spaces, F.array(F.lit(space)) if space else F.array().cast("array<string>"))), ", ")
    count = F.coalesce(F.col("manual_annotation_count").cast("string").try_cast("bigint"), F.lit(0)) + 1
    new = {
        "manual_annotation_count": count.cast(records.schema["manual_annotation_count"].dataType),
        "manual_annotation_pairs_text": F.when(pairs == "", F.lit(pair)).otherwise(F.concat(pairs, F.lit("\n" + pair))),
        "manual_annotation_namespaces_text": spaces,
    }
    return records.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})


# ---------------------------------------------------------------- enrichment and export
def enriched_paragraphs(rendered: DataFrame, selected: DataFrame, paragraphs: DataFrame, documents: DataFrame, explained: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """Rendered paragraphs with the selection's ids and categories, metadata, explanations and annotations."""
    out = rendered.drop("sentence_count").join(selected, "paragraph_id").join(paragraphs.select("paragraph_id", "document_id"), "paragraph_id", "left").join(documents.select("document_id", "category1", "category2"), "document_id", "left")
    out = out.join(explained, "paragraph_id", "left") if explained is not None else out
    return out.join(annotation_summary(annotations), "paragraph_id", "left") if annotations is not None else out


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order; texts that are missing become empty, counts 0."""

    def one(c: str) -> Column:
        count = c.endswith("_count") or c.endswith("_id") or "_no_in_" in c
        if c not in df.columns:
            return (F.lit(0).cast("long") if count else F.lit("")).alias(c)
        return (F.coalesce(F.col(c), F.lit(0)).cast("long") if count else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)

    return df.select(*map(one, columns))


def paragraph_export(enriched: DataFrame) -> DataFrame:
    return _filled(_renamed(enriched, "paragraph"), PARAGRAPH_COLUMNS)


def sentence_export(enriched: DataFrame) -> DataFrame:
    return _filled(_renamed(enriched, "sentence"), SENTENCE_COLUMNS)


def _renamed(df: DataFrame, unit: str) -> DataFrame:
    for a, b in ((f"{unit}_text_html", f"{unit}_text_highlight_html"), ("text_group_explanations_text", "text_groups_explanations_text")):
        df = df.withColumnRenamed(a, b)
    return df.withColumn("match_group_ids_text", F.array_join("match_group_ids", ", ")) if "match_group_ids" in df.columns else df


def gui_records(export: DataFrame) -> DataFrame:
    """Every column as text, null as empty, without the HTML."""
    return export.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in export.columns if not c.endswith("_highlight_html")))


def form_group_columns(rules) -> tuple[dict[str, str], dict[str, str]]:
    """Texts of a rule's group ids and logics."""
    ids, logics = {}, {}
    for r in rules.rules:
        texts = [g.match_logic if k == 1 else f"{g.combine_logic} {g.match_logic}" for k, g in enumerate(r.form_groups, 1)]
        ids[r.id] = ", ".join(f"{r.id}:g{k}" for k in range(1, len(texts) + 1))
        logics[r.id] = ", ".join(f"{r.id}:g{k}={t}" for k, t in enumerate(texts, 1))
    return ids, logics


def write_csv(df: DataFrame, path: str, bom: bool = False, crlf: bool = False) -> int:
    """One CSV file, written beside its place and moved there. Rows come to the driver partition by partition.

    A sink for results that a person reads; large results go out by ``df.write``.
    """
    import csv

    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    n = 0
    with os.fdopen(handle, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n" if crlf else "\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    os.replace(temporary, path)
    return n


#: The fields of a warning in the meta file.
WARNING_FIELDS = (
    "code", "message", "conditionId", "unitId", "requestedMode", "usedMode", "combinationCount", "combinationCap", "safetyLimit", "severity", "scope", "fieldName", "queryName", "dbPath", "targetId", "rowNumber",
)


def fallback_message(warning: dict, cap: int) -> dict:
    """A unit whose combinations exceeded the cap, as the meta file says it."""
    known = {
        "code": "distance_match_fallback", "message": f"{warning['combination_count']} combinations are more than the cap of {cap}; the greedy search was used", "conditionId": warning["condition_id"], "unitId": warning["unit_id"],
        "requestedMode": "auto-approx", "usedMode": "approx", "combinationCount": warning["combination_count"], "combinationCap": cap,
    }
    return {f: known.get(f) for f in WARNING_FIELDS}


def issue_message(issue) -> dict:
    """An issue of the rules or of reading, with the same fields."""
    known = {"code": issue.code, "message": issue.message, "conditionId": issue.condition_id, "severity": issue.severity, "scope": issue.scope, "fieldName": issue.field_name}
    return {f: known.get(f) for f in WARNING_FIELDS}


def write_view(records: DataFrame, path: str) -> int:
    """The records that a filter left, as a CSV for spreadsheets (byte-order mark, CRLF). They have to be of one unit.

    Records have ``sentence_id`` where they are sentences; a frame whose rows have it in part only mixes units. No record
    is an error, as there is nothing to save.
    """
    by_sentence = F.count("sentence_id") if "sentence_id" in records.columns else F.lit(0)
    found = records.agg(F.count(F.lit(1)).alias("n"), by_sentence.alias("s")).first()
    if not found.n:
        raise ValueError("there are no records to save")
    if found.s not in (0, found.n):
        raise ValueError(f"{found.s} of {found.n} records are sentences, the others paragraphs; a file has one unit")
    return write_csv(records if found.s or "sentence_id" not in records.columns else records.drop("sentence_id"), path, bom=True, crlf=True)


def write_meta(path: str, **values) -> None:
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2, default=str)
    os.replace(temporary, path)


# ---------------------------------------------------------------- facets
def facet_counts(records: DataFrame, columns: dict[str, bool] | None = None) -> DataFrame:
    """``facet, value, count`` over all records; several columns in one pass. True marks multi-valued columns."""
    columns = {c: m for c, m in (columns or FACETS).items() if c in records.columns}

    def values(c: str, multi: bool) -> Column:
        v = facet_values(F.col(c)) if multi else F.array(uni_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        return F.transform(v, lambda x: F.struct(F.lit(c).alias("facet"), x.alias("value")))

    return records.select(F.explode(F.concat(*(values(c, m) for c, m in columns.items()))).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("count"))


def facet_filter(records: DataFrame, chosen: dict[str, list[str]], multi: dict[str, bool] | None = None) -> DataFrame:
    """Records that match: and across columns, or within one; a column without chosen values passes all."""
    multi = multi or FACETS
    for c, values in chosen.items():
        if not values:
            continue
        if multi.get(c):
            records = records.where(F.arrays_overlap(facet_values(F.col(c)), F.array(*map(F.lit, values))))
        else:
            records = records.where(uni_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin(values))
    return records


def facet_search(counts: DataFrame, query: str) -> DataFrame:
    """Facet values that contain the query, case and outer space apart."""
    return counts.where(F.lower(uni_trim(F.col("value"))).contains(query.strip().lower()))


def facet_list(counts: DataFrame, query: str = "", chosen: dict[str, list[str]] | None = None) -> DataFrame:
    """Facet values as a list shows them: ``facet, value, count, is_chosen, is_match``, in order.

    Values that match the query, and apart from them (``is_match`` false) the chosen ones that don't. Ids and counts
    are ordered by number, the others by text, empty values first.
    """
    wanted = F.lit(False)
    for c, values in (chosen or {}).items():
        wanted = wanted | ((F.col("facet") == c) & F.col("value").isin(*values)) if values else wanted
    match = F.lower(uni_trim(F.col("value"))).contains(query.strip().lower())
    rows = counts.withColumns({"is_chosen": wanted, "is_match": match}).where("is_match or is_chosen")
    number = F.when(F.col("facet").isin(*NUMERIC_FACETS), F.col("value").try_cast("bigint"))
    return rows.orderBy("facet", F.desc("is_match"), F.col("value") != "", F.when(F.col("facet").isin(*NUMERIC_FACETS), number.isNull()), number, "value")


# ---------------------------------------------------------------- neighbours
def context_by_location(paragraphs: DataFrame, document_id: int, paragraph_no: int, radius: int = 2) -> DataFrame:
    """Paragraphs around a place of a document; the place itself need not exist."""
    near = paragraphs.where((F.col("document_id") == document_id) & F.col("paragraph_no").between(max(paragraph_no - radius, 1), paragraph_no + radius))
    return near.withColumn("is_center", F.col("paragraph_no") == paragraph_no).orderBy("paragraph_no")


def paragraph_context(paragraphs: DataFrame, wanted: DataFrame, radius: int = 2) -> DataFrame:
    """Paragraphs around the wanted ones in their documents; the wanted one is marked."""
    centre = wanted.select(F.col("paragraph_id").alias("center_id")).join(paragraphs.select(F.col("paragraph_id").alias("center_id"), F.col("document_id"), F.col("paragraph_no").alias("center_no")), "center_id")
    near = centre.select("center_id", "document_id", "center_no", F.explode(F.sequence(F.greatest(F.col("center_no") - radius, F.lit(1)), F.col("center_no") + radius)).alias("paragraph_no"))
    return near.join(paragraphs, ["document_id", "paragraph_no"]).withColumn("is_center", F.col("paragraph_no") == F.col("center_no"))


def neighbours(context: DataFrame) -> DataFrame:
    """Nearest paragraph number before and after each centre, in the loaded context."""
    before, after = F.col("paragraph_no") < F.col("center_no"), F.col("paragraph_no") > F.col("center_no")
    return context.groupBy("center_id").agg(F.max(F.when(before, F.col("paragraph_no"))).alias("previous_no"), F.min(F.when(after, F.col("paragraph_no"))).alias("next_no"))


def condition_rollup(condition_eval: DataFrame) -> DataFrame:
    """Per rule: paragraphs looked at, matched, and matched units."""
    return condition_eval.groupBy("condition_id").agg(
        F.first("category_text").alias("category_text"), F.count(F.lit(1)).alias("evaluated_paragraphs"), F.count_if("is_match").alias("matched_paragraphs"), F.sum("matched_unit_count").alias("matched_units")
    )


# ---------------------------------------------------------------- the rules themselves as records
def rule_records(spark, rules) -> DataFrame:
    """One record per rule, to be counted and filtered by facets like results."""
    rows = []
    for r in rules.rules:
        scopes = sorted({g.search_scope for g in (*r.form_groups, *r.text_groups)} or {r.search_scope})
        rows.append((
            r.id, ", ".join(r.categories), "mixed" if len(scopes) > 1 else scopes[0], "; ".join(sorted({g.match_logic for g in r.form_groups})), str(len(r.form_groups)),
            "yes" if any(g.distance is not None for g in r.form_groups) or r.distance is not None else "no", "yes" if r.text_groups else "no", "yes" if r.annotation_filters else "no", "yes" if r.has_reference else "no",
        ))
    names = ("condition_id", "categories", "scope", "logics", "group_count", "has_distance", "has_text", "has_annotation", "has_reference")
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


RULE_FACETS = {"condition_id": False, "categories": True, "scope": False, "logics": True, "group_count": False, "has_distance": False, "has_text": False, "has_annotation": False, "has_reference": False}
