"""Token positions, text units and their reconstruction from tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


COLUMNS = ["paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", "token_no", "sentence_token_position", "paragraph_token_position", "normalized_form", "surface"]


def positioned(tokens: DataFrame, sentences: DataFrame, forms: list[str] | None = None, paragraph_ids: DataFrame | None = None, without_tables: bool = False) -> DataFrame:
    """Tokens with their positions in sentence and paragraph.

    A paragraph position is the token's number plus all tokens of the earlier sentences of its paragraph. The filter on
    ``forms`` applies after positions are known. ``paragraph_ids`` (one column) restricts both sides before. Tokens
    that have positions already (see ``ingest.positioned_tokens``) are only filtered. For others tokens are counted per
    sentence and summed over sentences; the tokens themselves are joined once, and only those that ``forms`` keeps.
    """
    ready = "paragraph_token_position" in tokens.columns
    if paragraph_ids is not None:
        tokens = tokens.join(paragraph_ids, "paragraph_id", "left_semi")
    wanted = tokens if forms is None else tokens.where(F.col("normalized_form").isin(forms))
    if ready:
        return (wanted.where("is_table_paragraph = 0") if without_tables else wanted).select(*COLUMNS)
    if paragraph_ids is not None:
        sentences = sentences.join(paragraph_ids, "paragraph_id", "left_semi")
    if without_tables:
        sentences = sentences.where("is_table_paragraph = 0")
    keys = ["paragraph_id", "sentence_id"]
    counted = sentences.select(*keys, "sentence_no_in_paragraph", "is_table_paragraph").join(tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    order = Window.partitionBy("paragraph_id").orderBy("sentence_no_in_paragraph").rangeBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    rows = wanted.select(*keys, "token_no", "normalized_form", "surface").join(before, keys)
    return rows.withColumn("sentence_token_position", F.col("token_no")).withColumn("paragraph_token_position", F.col("before") + F.col("token_no")).select(*COLUMNS)


def paragraph_texts(sentences: DataFrame) -> DataFrame:
    """Paragraph text from its sentences in order; lines of tables are joined by a line feed."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sentence_no_in_paragraph", "sentence_id", F.coalesce("sentence_text", F.lit("")).alias("t")))), lambda x: x["t"])
    grouped = sentences.groupBy("paragraph_id").agg(F.max("is_table_paragraph").alias("is_table_paragraph"), parts.alias("p"), F.count(F.lit(1)).alias("sentence_count"))
    return grouped.select("paragraph_id", "is_table_paragraph", F.when(F.col("is_table_paragraph") == 1, F.array_join("p", "\n")).otherwise(F.array_join("p", "")).alias("paragraph_text"), "sentence_count")


def sentences_from_tokens(tokens: DataFrame) -> DataFrame:
    """Sentence text as the joined surfaces of its tokens."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("token_no", F.coalesce("surface", F.lit("")).alias("s")))), lambda x: x["s"])
    return tokens.groupBy("paragraph_id", "sentence_id").agg(F.array_join(parts, "").alias("sentence_text"))


def token_lists(tokens: DataFrame) -> DataFrame:
    """Token rows gathered by sentence, in order: ``surfaces`` and the tokens' numbers, ``token_nos``. A frame that has
    ``surfaces`` already (see ``ingest.token_lists``) stays as it is."""
    if "surfaces" in tokens.columns:
        return tokens
    parts = F.array_sort(F.collect_list(F.struct("token_no", F.coalesce("surface", F.lit("")).alias("s"))))
    rows = tokens.groupBy("paragraph_id", "sentence_id").agg(F.max("sentence_no_in_paragraph").alias("sentence_no_in_paragraph"), F.max("is_table_paragraph").alias("is_table_paragraph"), parts.alias("p"))
    return rows.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", F.col("p.s").alias("surfaces"), F.col("p.token_no").alias("token_nos"))


def sentences_from_lists(lists: DataFrame) -> DataFrame:
    """Sentence text as the joined surfaces of the sentence's tokens, with their number; sentences without tokens are left out."""
    rows = lists.where(F.size("surfaces") > 0)
    return rows.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", F.array_join("surfaces", "").alias("sentence_text"), F.size("surfaces").cast("long").alias("token_count"))


def paragraphs_from_tokens(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    made = sentences_from_tokens(tokens)
    return paragraph_texts(sentences.drop("sentence_text").join(made, ["paragraph_id", "sentence_id"]))


def only_sentences_of(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences that have one of the given tokens."""
    return sentences.join(tokens, ["paragraph_id", "sentence_id"], "left_semi")


def coverage(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Tokens per sentence, sentences without any included."""
    counted = tokens.groupBy("paragraph_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"))
    out = sentences.select("paragraph_id", "sentence_id").join(counted, ["paragraph_id", "sentence_id"], "left")
    return out.select("paragraph_id", "sentence_id", F.coalesce("n", F.lit(0)).alias("token_count"), (F.coalesce("n", F.lit(0)) > 0).alias("has_display_tokens"))
