"""Queries by name, each with the same in DuckDB's SQL.

All run over whole tables: ``documents`` as the corpus (category1 = source, category2 = lang), ``labels`` as manual
annotations of first paragraphs, ``conversations`` as documents of turns, ``benchmark`` for phrases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import html_escape
from tessera.operators import evaluate, groups as group_units, hits, ingest, lattice, output, positions, render, select
from tessera.plans.config import compile_authoring, compile_runtime
from tessera.plans.rules import RuleSet
from tessera.session import Session
from tessera.sources import scratch

FLAGSHIP = "cooccur_all"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH DOC") else BASE + sql
        return f

    return add


# ---------------------------------------------------------------- the corpus in both languages
class Corpus:
    """The documents of a folder as a corpus.

    ``raw`` makes every table from the texts. Otherwise the sentences are made once per application and folder, with the
    tokens before each in its paragraph, written to the scratch folder, and read from there by every later query, as long
    as the source file is the same. Paragraphs and tokens follow from them without a shuffle and are not written.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, raw: bool = False):
        path = f"{sf_dir}/documents.parquet"
        stamp = scratch.stamp(spark, path)
        self.documents = ingest.documents_frame(scratch.spread(spark.read.parquet(path), stamp[1]))
        sentences = ingest.numbered_sentences(self.documents, ingest.TOKEN)
        if raw:
            self.paragraphs, self.sentences = ingest.paragraphs_frame(self.documents), sentences
        else:
            self.sentences = scratch.kept(spark, (path, stamp), lambda: {"sentences": sentences})["sentences"]
            # a paragraph has a first sentence
            self.paragraphs = self.sentences.where("sentence_no_in_paragraph = 1").select("paragraph_id", "document_id", "paragraph_no", "is_table_paragraph")
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        pairs = F.array(*(F.struct(F.lit(k).alias("label_key"), F.col(k).cast("string").alias("label_value")) for k in ("quality", "toxic")))
        self.annotations = labels.select((F.col("doc_id") * ingest.PARAGRAPH_STEP + 1).alias("paragraph_id"), F.lit("label").alias("label_namespace"), F.explode(pairs).alias("x")).select("paragraph_id", "label_namespace", "x.*")

    @property
    def tokens(self) -> DataFrame:
        return self.tokens_of(None)

    def tokens_of(self, forms: list[str] | None) -> DataFrame:
        return ingest.tokens_of_sentences(self.sentences, forms)

    @property
    def lists(self) -> DataFrame:
        return ingest.token_lists(self.sentences)

    @property
    def positioned(self) -> DataFrame:
        return positions.positioned(self.tokens, self.sentences)

    def evaluate(self, rules: RuleSet) -> evaluate.Evaluation:
        annotated = any(r.annotation_filters for r in rules.rules)
        return evaluate.Evaluation(rules, self.tokens_of(rules.vocabulary), self.sentences, output.annotation_pairs(self.annotations) if annotated else None).build()

    def matched(self, rules: RuleSet) -> DataFrame:
        return select.select_paragraphs(self.evaluate(rules)).select("paragraph_id", "matched_condition_ids_text")

    def hits(self, rules: RuleSet) -> DataFrame:
        return hits.locate(positions.positioned(self.tokens_of(rules.vocabulary), self.sentences, rules.vocabulary), rules).rows


BASE = r"""
WITH doc AS (SELECT doc_id AS document_id, coalesce(source, '') AS category1, coalesce(lang, '') AS category2, coalesce(text, '') AS raw_text FROM documents),
ln AS (SELECT document_id, unnest(string_split(raw_text, chr(10))) AS l, unnest(range(len(string_split(raw_text, chr(10))))) AS i FROM doc),
par AS (SELECT document_id * 100000 + paragraph_no AS paragraph_id, document_id, paragraph_no, paragraph_text FROM (
  SELECT document_id, trim(l) AS paragraph_text, row_number() OVER (PARTITION BY document_id ORDER BY i) AS paragraph_no FROM ln WHERE trim(l) <> '')),
sx AS (SELECT paragraph_id, document_id, paragraph_no, regexp_extract_all(paragraph_text, '[^。．.!?！？]*[。．.!?！？][」』）)\]】〉》"'']*|[^。．.!?！？]+$') AS s FROM par),
sen AS (SELECT paragraph_id * 10000 + n AS sentence_id, paragraph_id, document_id, paragraph_no, n AS sentence_no_in_paragraph, t AS sentence_text FROM (
  SELECT paragraph_id, document_id, paragraph_no, trim(t) AS t, row_number() OVER (PARTITION BY paragraph_id ORDER BY i) AS n FROM (
    SELECT paragraph_id, document_id, paragraph_no, unnest(s) AS t, unnest(range(len(s))) AS i FROM sx) WHERE trim(t) <> '')),
tok AS (SELECT paragraph_id, sentence_id, sentence_no_in_paragraph, token_no, lower(surface) AS normalized_form, surface FROM (
  SELECT paragraph_id, sentence_id, sentence_no_in_paragraph, unnest(x) AS surface, unnest(range(1, len(x) + 1)) AS token_no FROM (
    SELECT *, regexp_extract_all(sentence_text, '[^ .,!?]+') AS x FROM sen))),
cnt AS (SELECT paragraph_id, sentence_id, sentence_no_in_paragraph, count(*) AS n FROM tok GROUP BY ALL),
off AS (SELECT paragraph_id, sentence_id, coalesce(sum(n) OVER (PARTITION BY paragraph_id ORDER BY sentence_no_in_paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM cnt),
pos AS (SELECT t.*, t.token_no AS sentence_token_position, o.o + t.token_no AS paragraph_token_position FROM tok t JOIN off o USING (paragraph_id, sentence_id)),
ann AS (SELECT doc_id * 100000 + 1 AS paragraph_id, 'label' AS label_namespace, unnest(['quality', 'toxic']) AS label_key, unnest([quality::VARCHAR, toxic::VARCHAR]) AS label_value FROM labels)
"""


def runtime(*conditions: dict, **settings) -> RuleSet:
    rules = compile_runtime({"max_reconstructed_paragraphs": select.UNCAPPED, **settings, "cooccurrence_conditions": list(conditions)})
    assert not any(i.severity == "error" for i in rules.issues), rules.issues
    return rules


def ids(*pairs: tuple[str, str]) -> str:
    """SQL: paragraphs with the ids of the rules whose sub-queries hold them."""
    union = " UNION ALL ".join(f"SELECT paragraph_id, '{i}' AS c FROM ({q})" for i, q in pairs)
    return f"SELECT paragraph_id, string_agg(DISTINCT c, ', ' ORDER BY c) AS matched_condition_ids_text FROM ({union}) GROUP BY paragraph_id"


def has_all(*forms: str, unit: str = "paragraph_id") -> str:
    listed = ", ".join(f"'{f}'" for f in forms)
    return f"SELECT DISTINCT paragraph_id FROM (SELECT paragraph_id, {unit} FROM pos WHERE normalized_form IN ({listed}) GROUP BY paragraph_id, {unit} HAVING count(DISTINCT normalized_form) = {len(forms)})"


def has_any(*forms: str) -> str:
    return f"SELECT DISTINCT paragraph_id FROM pos WHERE normalized_form IN ({', '.join(f'{chr(39)}{f}{chr(39)}' for f in forms)})"


def condition(i: str, categories: list[str] | None = None, **rest) -> dict:
    return {"condition_id": i, "categories": categories or ["c"], **rest}


def groups(i: str, *form_groups: dict, scope: str = "paragraph", **rest) -> dict:
    return condition(i, overall_search_scope=scope, form_groups=list(form_groups), **rest)


# ---------------------------------------------------------------- ingest
@query("SELECT document_id, category1, category2, sha256(raw_text) AS text_sha256, length(raw_text) AS char_count, CASE WHEN raw_text = '' THEN 0 ELSE length(raw_text) - length(replace(raw_text, chr(10), '')) + 1 END AS line_count FROM doc")
def document_stats(spark, d):
    return Corpus(spark, d, raw=True).documents.drop("raw_text")


@query("SELECT paragraph_id, document_id, paragraph_no, paragraph_text FROM par")
def paragraph_split(spark, d):
    return Corpus(spark, d, raw=True).paragraphs.select("paragraph_id", "document_id", "paragraph_no", "paragraph_text")


@query("SELECT sentence_id, paragraph_id, sentence_no_in_paragraph, row_number() OVER (PARTITION BY document_id ORDER BY paragraph_no, sentence_no_in_paragraph) AS sentence_no_in_document, sentence_text FROM sen")
def sentence_split_v1(spark, d):
    return ingest.numbered_sentences(Corpus(spark, d, raw=True).documents).select("sentence_id", "paragraph_id", "sentence_no_in_paragraph", "sentence_no_in_document", "sentence_text")


#: Sentences of the paragraphs that hold a bracket: a list is folded character by character, with the open brackets, the
#: sentence so far, whether its end has come, and the sentences before.
V2 = r"""
, br AS (SELECT paragraph_id, list_reduce(regexp_extract_all(paragraph_text, '(?s).'), lambda a, ch:
    CASE WHEN a.done AND contains('」』）)]】〉》"''''', ch) THEN {'open': a.open, 'buf': a.buf || ch, 'done': true, 'out': a.out}
    ELSE {'open': CASE WHEN contains('(（「『【［〈《', ch) THEN a.open || ch
                       WHEN contains(')）」』】］〉》', ch) AND contains(a.open, translate(ch, ')）」』】］〉》', '(（「『【［〈《'))
                       THEN left(a.open, length(a.open) - strpos(reverse(a.open), translate(ch, ')）」』】］〉》', '(（「『【［〈《'))::INTEGER) ELSE a.open END,
          'buf': CASE WHEN a.done THEN ch ELSE a.buf || ch END,
          'done': contains('。．.!?！？', ch) AND (a.open = '' OR (length(a.open) = 1 AND a.open = translate(ch, ')）」』】］〉》', '(（「『【［〈《'))),
          'out': CASE WHEN a.done THEN list_append(a.out, trim(a.buf)) ELSE a.out END} END,
    {'open': '', 'buf': '', 'done': false, 'out': []::VARCHAR[]}) AS r, paragraph_text FROM par WHERE regexp_matches(paragraph_text, '[()（）「」『』【】［］〈〉《》]')),
bl AS (SELECT paragraph_id, paragraph_text, list_filter(list_append(r.out, trim(r.buf)), lambda t: t <> '') AS t FROM br),
bs AS (SELECT paragraph_id, CASE WHEN len(t) = 0 THEN [paragraph_text] ELSE t END AS t FROM bl)
SELECT sentence_id, paragraph_id, sentence_no_in_paragraph, sentence_text FROM sen WHERE paragraph_id NOT IN (SELECT paragraph_id FROM bs)
UNION ALL SELECT paragraph_id * 10000 + n, paragraph_id, n, s FROM (SELECT paragraph_id, unnest(t) AS s, unnest(range(1, len(t) + 1)) AS n FROM bs)"""


@query(V2)
def sentence_split_v2(spark, d):
    return ingest.sentences_frame(Corpus(spark, d, raw=True).paragraphs, inside_brackets=False).select("sentence_id", "paragraph_id", "sentence_no_in_paragraph", "sentence_text")


# no document has a table's rule line, so all are plain; table_sentences has the tables
@query("SELECT paragraph_id, paragraph_no, paragraph_text, 0::BIGINT AS is_table_paragraph, NULL::BIGINT AS table_column_count, 0::BIGINT AS table_parse_error, 0::BIGINT AS table_trailing_text_detached FROM par WHERE (SELECT count(*) FROM doc WHERE contains(raw_text, '--')) = 0")
def table_paragraphs(spark, d):
    return ingest.paragraphs_frame(Corpus(spark, d, raw=True).documents, tables=True).drop("document_id")


@query("SELECT paragraph_id, sentence_id, token_no, sentence_token_position, paragraph_token_position, normalized_form, surface FROM pos")
def token_positions(spark, d):
    return Corpus(spark, d, raw=True).positioned.drop("sentence_no_in_paragraph", "is_table_paragraph")


@query(", tc AS (SELECT 'documents' AS counter, count(*) AS value FROM doc UNION ALL SELECT 'empty_documents', count(*) FILTER (raw_text = '') FROM doc UNION ALL SELECT 'characters', sum(length(raw_text)) FROM doc UNION ALL SELECT 'paragraphs', count(*) FROM par UNION ALL SELECT 'table_paragraphs', 0 UNION ALL SELECT 'table_errors', 0 UNION ALL SELECT 'sentences', count(*) FROM sen UNION ALL SELECT 'tokens', count(*) FROM tok UNION ALL SELECT 'forms', count(DISTINCT normalized_form) FROM tok) SELECT counter, value::BIGINT AS value FROM tc")
def corpus_stats(spark, d):
    return ingest.plain_corpus_stats(Corpus(spark, d, raw=True).documents)


@query("SELECT paragraph_id, string_agg(sentence_text, '' ORDER BY sentence_no_in_paragraph) AS paragraph_text, count(*) AS sentence_count FROM sen GROUP BY paragraph_id")
def text_units(spark, d):
    return positions.paragraph_texts(Corpus(spark, d).sentences).select("paragraph_id", "paragraph_text", "sentence_count")


@query("SELECT paragraph_id, sentence_id, coalesce(n, 0) AS token_count, coalesce(n, 0) > 0 AS has_display_tokens FROM sen LEFT JOIN cnt USING (paragraph_id, sentence_id)")
def sentence_coverage(spark, d):
    c = Corpus(spark, d)
    return positions.coverage(c.tokens, c.sentences)


@query("SELECT paragraph_id, sentence_id, string_agg(surface, '' ORDER BY token_no) AS sentence_text FROM tok GROUP BY paragraph_id, sentence_id")
def sentences_rebuilt(spark, d):
    return positions.sentences_from_lists(Corpus(spark, d).lists).select("paragraph_id", "sentence_id", "sentence_text")


@query("SELECT paragraph_id, string_agg(s, '' ORDER BY sentence_id) AS paragraph_text FROM (SELECT paragraph_id, sentence_id, string_agg(surface, '' ORDER BY token_no) AS s FROM tok GROUP BY paragraph_id, sentence_id) GROUP BY paragraph_id")
def paragraphs_rebuilt(spark, d):
    return positions.paragraph_texts(positions.sentences_from_lists(Corpus(spark, d).lists)).select("paragraph_id", "paragraph_text")


@query(r"SELECT sentence_id, len(x) AS n_tokens, array_to_string(x, '') AS sentence_text FROM (SELECT sentence_id, regexp_extract_all(sentence_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS x FROM sen)")
def lossless_tokens(spark, d):
    lists = ingest.token_lists(Corpus(spark, d).sentences, lossless=True)
    return positions.sentences_from_lists(lists).select("sentence_id", F.col("token_count").alias("n_tokens"), "sentence_text")


def _supplier_documents(spark, d) -> DataFrame:
    """A document per nation: a sentence, then a pipe table of its suppliers; text stands behind every odd table."""
    row = F.concat(F.lit("| "), F.coalesce("s_name", F.lit("")), F.lit(" | "), F.col("s_suppkey").cast("string"), F.lit(" |"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), "n_name")
    tail = F.when(F.col("k") % 2 == 1, F.lit(" Checked (twice. Yes). Done.")).otherwise(F.lit(""))
    text = F.concat(F.lit("Suppliers of "), "n_name", F.lit(".\n\n| name | key |\n|---|:--:|\n"), "rows", tail)
    return ingest.documents_frame(nations.join(rows, "k").select(F.col("k").alias("doc_id"), text.alias("text"), F.lit("").alias("source"), F.lit("").alias("lang")))


TABLES = """, su AS (SELECT s_nationkey::BIGINT AS k, n_name, list('| ' || s_name || ' | ' || s_suppkey || ' |' ORDER BY s_suppkey) AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
 tp AS (SELECT k * 100000 + 1 AS paragraph_id, 0::BIGINT AS is_table_paragraph, NULL::BIGINT AS table_column_count, 0::BIGINT AS table_trailing_text_detached, ['Suppliers of ' || n_name || '.'] AS t FROM su
  UNION ALL SELECT k * 100000 + 2, 1, 2, k % 2, list_concat(['| name | key |'], r) FROM su
  UNION ALL SELECT k * 100000 + 3, 0, NULL, 0, ['Checked (twice. Yes).', 'Done.'] FROM su WHERE k % 2 = 1)"""


@query(TABLES + " SELECT paragraph_id * 10000 + n AS sentence_id, paragraph_id, is_table_paragraph, n AS sentence_no_in_paragraph, s AS sentence_text FROM (SELECT paragraph_id, is_table_paragraph, unnest(t) AS s, unnest(range(1, len(t) + 1)) AS n FROM tp)")
def table_sentences(spark, d):
    paragraphs = ingest.paragraphs_frame(_supplier_documents(spark, d), tables=True)
    return ingest.sentences_frame(paragraphs, inside_brackets=False).select("sentence_id", "paragraph_id", "is_table_paragraph", "sentence_no_in_paragraph", "sentence_text")


@query(TABLES + " SELECT paragraph_id, is_table_paragraph, table_column_count, 0::BIGINT AS table_parse_error, table_trailing_text_detached, len(t) + is_table_paragraph AS n_lines FROM (SELECT * FROM tp) WHERE is_table_paragraph = 1")
def table_descriptions(spark, d):
    rows = ingest.paragraphs_frame(_supplier_documents(spark, d), tables=True).where("is_table_paragraph = 1")
    return rows.select("paragraph_id", "is_table_paragraph", "table_column_count", "table_parse_error", "table_trailing_text_detached", F.size(F.split("paragraph_text", "\n")).cast("long").alias("n_lines"))


# ---------------------------------------------------------------- token rules
@query(ids(("all", has_all("the", "of", "and"))))
def cooccur_all(spark, d):
    return Corpus(spark, d).matched(runtime(condition("all", forms=["the", "of", "and"])))


@query(ids(("any", has_any("der", "die", "los"))))
def cooccur_any(spark, d):
    return Corpus(spark, d).matched(runtime(condition("any", forms=["der", "die", "los"], form_match_logic="any")))


@query(ids(("sent", has_all("the", "of", "and", unit="sentence_id"))))
def cooccur_sentence(spark, d):
    return Corpus(spark, d).matched(runtime(condition("sent", forms=["the", "of", "and"], search_scope="sentence")))


NEAR = "SELECT DISTINCT paragraph_id FROM (SELECT paragraph_id, len(list_distinct(list(normalized_form) OVER (PARTITION BY {unit} ORDER BY {pos} RANGE BETWEEN CURRENT ROW AND {d} FOLLOWING))) AS k FROM pos WHERE normalized_form IN ({forms})) WHERE k = {k}"


@query(ids(("near", NEAR.format(unit="paragraph_id", pos="paragraph_token_position", d=6, forms="'the', 'of', 'and'", k=3)), ("snear", NEAR.format(unit="sentence_id", pos="sentence_token_position", d=3, forms="'de', 'la'", k=2))))
def proximity_k_way(spark, d):
    return Corpus(spark, d).matched(runtime(condition("near", forms=["the", "of", "and"], max_token_distance=6), condition("snear", forms=["de", "la"], max_token_distance=3, search_scope="sentence")))


def around(anchor: str, forms: tuple[str, ...], d: int, exclude: tuple[str, ...] = ()) -> str:
    """SQL: an anchor with all other forms within d and none of the excluded."""
    near = "EXISTS (SELECT 1 FROM pos b WHERE b.paragraph_id = a.paragraph_id AND b.normalized_form = '{f}' AND abs(b.paragraph_token_position - a.paragraph_token_position) <= {d})"
    tests = [near.format(f=f, d=d) for f in forms if f != anchor] + ["NOT " + near.format(f=f, d=d) for f in exclude]
    return f"SELECT DISTINCT a.paragraph_id FROM pos a WHERE a.normalized_form = '{anchor}' AND " + " AND ".join(tests)


@query(ids(("win", around("of", ("of", "the", "and"), 5))))
def anchor_window(spark, d):
    return Corpus(spark, d).matched(runtime(groups("win", {"forms": ["of", "the", "and"], "anchor_form": "of", "max_token_distance": 5})))


@query(ids(("winx", around("of", ("of", "the"), 4, ("and", "in")))))
def anchor_window_exclude(spark, d):
    return Corpus(spark, d).matched(runtime(groups("winx", {"forms": ["of", "the"], "anchor_form": "of", "max_token_distance": 4, "exclude_forms_any": ["and", "in"]})))


@query(ids(("orw", " UNION ".join(around(a, (a,), 3, ("the",)) for a in ("to", "that")))))
def or_window(spark, d):
    return Corpus(spark, d).matched(runtime(groups("orw", {"forms": ["to", "that"], "match_logic": "or", "max_token_distance": 3, "exclude_forms_any": ["the"]})))


@query(ids(("excl", f"{has_all('the', 'of')} EXCEPT {has_any('and')}")))
def exclude_any_unit(spark, d):
    return Corpus(spark, d).matched(runtime(groups("excl", {"forms": ["the", "of"], "exclude_forms_any": ["and"]})))


@query(ids(("not", f"{has_any('the')} EXCEPT {has_any('in', 'to')}")))
def not_group(spark, d):
    return Corpus(spark, d).matched(runtime(groups("not", {"forms": ["the"]}, {"forms": ["in", "to"], "match_logic": "not", "combine_logic": "and"})))


@query(ids(("chain", f"({has_all('the', 'of')} INTERSECT {has_any('in', 'to')}) UNION {has_all('der', 'die')}")))
def group_chain_and_or(spark, d):
    return Corpus(spark, d).matched(runtime(groups("chain", {"forms": ["the", "of"]}, {"forms": ["in", "to"], "match_logic": "or", "combine_logic": "and"}, {"forms": ["der", "die"], "combine_logic": "or"})))


@query(ids(("mixed", f"{has_all('the', 'of', unit='sentence_id')} INTERSECT {has_any('and')}")))
def scope_promotion(spark, d):
    return Corpus(spark, d).matched(runtime(groups("mixed", {"forms": ["the", "of"], "search_scope": "sentence"}, {"forms": ["and"], "search_scope": "paragraph", "combine_logic": "and"})))


# ---------------------------------------------------------------- text and annotation rules
@query(ids(("ta", "SELECT paragraph_id FROM (SELECT paragraph_id, string_agg(sentence_text, '' ORDER BY sentence_no_in_paragraph) AS t FROM sen GROUP BY 1) WHERE contains(t, 'the of') OR contains(t, 'de la')")))
def text_any(spark, d):
    return Corpus(spark, d).matched(runtime(condition("ta", text_groups=[{"texts": ["the of", "de la"], "match_logic": "or"}])))


@query(ids(("tl", "SELECT DISTINCT paragraph_id FROM sen WHERE contains(sentence_text, 'tion') AND contains(sentence_text, 'the')")))
def text_all(spark, d):
    return Corpus(spark, d).matched(runtime(condition("tl", overall_search_scope="sentence", text_groups=[{"texts": ["tion", "the"]}])))


@query(ids(("tn", "SELECT DISTINCT paragraph_id FROM sen WHERE contains(sentence_text, 'the') AND NOT (contains(sentence_text, 'tion') OR contains(sentence_text, '|'))")))
def text_not(spark, d):
    return Corpus(spark, d).matched(runtime(condition("tn", overall_search_scope="sentence", text_groups=[{"texts": ["the"]}, {"texts": ["tion", "|"], "match_logic": "not", "combine_logic": "and"}])))


@query(ids(("tt", f"{has_any('of')} INTERSECT SELECT DISTINCT paragraph_id FROM sen WHERE contains(sentence_text, 'tion')")))
def token_and_text(spark, d):
    return Corpus(spark, d).matched(runtime(condition("tt", forms=["of"], text_groups=[{"texts": ["tion"], "search_scope": "sentence"}])))


@query(ids(("af", "SELECT paragraph_id FROM ann WHERE label_key = 'quality' AND label_value = '1' INTERSECT SELECT paragraph_id FROM ann WHERE label_key = 'toxic' AND label_value = '0' INTERSECT SELECT paragraph_id FROM sen")))
def annotation_filter(spark, d):
    return Corpus(spark, d).matched(runtime(condition("af", annotation_filters=[{"namespace": "label", "key": "quality", "value": "1"}, {"namespace": "label", "key": "toxic", "value": "0"}])))


@query(ids(("at", f"SELECT paragraph_id FROM ann WHERE label_key = 'quality' AND label_value = '1' INTERSECT {has_any('the', 'der')}")))
def annotation_and_token(spark, d):
    return Corpus(spark, d).matched(runtime(condition("at", forms=["the", "der"], form_match_logic="any", annotation_filters=[{"namespace": "label", "key": "quality", "value": "1"}])))


# ---------------------------------------------------------------- references
A, B_ = has_all("the", "of"), has_any("and")


@query(ids(("a", A), ("cat", A)))
def category_reference(spark, d):
    return Corpus(spark, d).matched(runtime(condition("a", ["x"], forms=["the", "of"]), condition("cat", ["y"], required_categories_any=["x", "z"])))


@query(ids(("a", A), ("b", f"({A}) INTERSECT ({B_})"), ("c", f"({A}) INTERSECT ({B_})")))
def condition_reference_chain(spark, d):
    return Corpus(spark, d).matched(runtime(condition("c", required_condition_ids_all=["b"]), condition("b", forms=["and"], required_condition_ids_all=["a"]), condition("a", forms=["the", "of"])))


@query(ids(("a", A), ("b", f"({B_}) EXCEPT ({A})")))
def exclude_reference(spark, d):
    return Corpus(spark, d).matched(runtime(condition("a", forms=["the", "of"]), condition("b", forms=["and"], excluded_condition_ids_any=["a"])))


@query(f"SELECT paragraph_id, 'a, b' AS matched_condition_ids_text FROM (({A}) INTERSECT ({B_}))")
def match_all_logic(spark, d):
    return Corpus(spark, d).matched(runtime(condition("a", forms=["the", "of"]), condition("b", forms=["and"]), condition_match_logic="all"))


@query(f"SELECT paragraph_id FROM (SELECT paragraph_id, count(*) AS n FROM (SELECT * FROM ({A}) UNION ALL SELECT * FROM ({B_})) GROUP BY 1) ORDER BY n DESC, paragraph_id LIMIT 500")
def topk_paragraphs(spark, d):
    return Corpus(spark, d).matched(runtime(condition("a", forms=["the", "of"]), condition("b", forms=["and"]), max_reconstructed_paragraphs=500)).select("paragraph_id")


AUTHORED = {
    "format": "condition-authoring/v1", "settings": {"max_reconstructed_paragraphs": select.UNCAPPED}, "sets": {"articles": ["the", "a"]}, "defaults": {"scope": "sentence"},
    "rules": [
        {"id": "window", "label": "near", "match": {"token_window": {"terms": ["of", "the"], "anchor": "of", "distance": 3}}},
        {"id": "texts", "label": "text", "scope": "paragraph", "match": {"any": [{"text_all": ["tion", "ing"]}, {"text_any": ["| the"]}]}, "exclude_any": ["window"]},
        {"id": "skipped", "skip": True, "match": {"text_any": ["x"]}},
    ],
}
_W = "SELECT DISTINCT a.paragraph_id FROM pos a JOIN pos b ON a.sentence_id = b.sentence_id AND abs(a.token_no - b.token_no) <= 3 WHERE a.normalized_form = 'of' AND b.normalized_form = 'the'"


@query(ids(("window", _W), ("texts", f"SELECT paragraph_id FROM (SELECT paragraph_id, string_agg(sentence_text, '' ORDER BY sentence_no_in_paragraph) AS t FROM sen GROUP BY 1) WHERE (contains(t, 'tion') AND contains(t, 'ing')) OR contains(t, '| the') EXCEPT ({_W})")))
def authored_rules(spark, d):
    return Corpus(spark, d).matched(compile_authoring(AUTHORED).rule_set)


SENTENCE_RULES = (groups("s", {"forms": ["the", "of"], "search_scope": "sentence"}, scope="sentence"), condition("p", ["q"], forms=["and"]))
_S = "SELECT sentence_id FROM pos WHERE normalized_form IN ('the', 'of') GROUP BY 1 HAVING count(DISTINCT normalized_form) = 2"


@query(f"SELECT paragraph_id, sentence_id, string_agg(c, ', ' ORDER BY c) AS matched_condition_ids_text FROM (SELECT paragraph_id, sentence_id, 's' AS c FROM cnt WHERE sentence_id IN ({_S}) UNION ALL SELECT paragraph_id, sentence_id, 'p' FROM cnt WHERE paragraph_id IN ({B_})) GROUP BY 1, 2")
def sentence_mode_select(spark, d):
    c = Corpus(spark, d)
    rules = runtime(*SENTENCE_RULES, analysis_unit="sentence")
    return select.SentenceSelection(c.evaluate(rules), c.tokens).sentences().select("paragraph_id", "sentence_id", "matched_condition_ids_text")


@query(f", m AS ({A}), u AS (SELECT DISTINCT paragraph_id FROM pos WHERE normalized_form IN ('the', 'of', 'and')) SELECT 'a' AS condition_id, 'c' AS category_text, count(*) AS evaluated_paragraphs, count(*) FILTER (paragraph_id IN (SELECT * FROM m)) AS matched_paragraphs, count(*) FILTER (paragraph_id IN (SELECT * FROM m))::BIGINT AS matched_units FROM u UNION ALL SELECT 'b', 'c', count(*), count(*) FILTER (paragraph_id IN ({B_})), (SELECT count(*) FROM (SELECT DISTINCT sentence_id FROM pos WHERE normalized_form = 'and')) FROM u")
def condition_rollup(spark, d):
    rules = runtime(condition("a", forms=["the", "of"]), condition("b", forms=["and"], search_scope="sentence"))
    return output.condition_rollup(Corpus(spark, d).evaluate(rules).condition_eval())


# ---------------------------------------------------------------- hits
HIT_COLUMNS = ["paragraph_id", "sentence_id", "token_no", "condition_id", "match_group_id", "match_role"]
SIMPLE = runtime(condition("s1", ["x"], forms=["the", "of"], search_scope="sentence"), condition("s2", ["y"], forms=["der", "los"], form_match_logic="any"))
SIMPLE_SQL = f"""
 s1 AS (SELECT paragraph_id, sentence_id, token_no, surface, normalized_form, 's1' AS condition_id, 's1:' || sentence_id || ':token:' || row_number() OVER (PARTITION BY sentence_id ORDER BY token_no) AS match_group_id FROM pos WHERE normalized_form IN ('the', 'of') AND sentence_id IN ({_S})),
 s2 AS (SELECT paragraph_id, sentence_id, token_no, surface, normalized_form, 's2', 's2:' || paragraph_id || ':token:' || row_number() OVER (PARTITION BY paragraph_id ORDER BY paragraph_token_position) FROM pos WHERE normalized_form IN ('der', 'los')),
 h AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2)
"""


@query(f", {SIMPLE_SQL} SELECT paragraph_id, sentence_id, token_no, condition_id, match_group_id, normalized_form AS match_role FROM h")
def simple_hits(spark, d):
    return Corpus(spark, d).hits(SIMPLE).select(HIT_COLUMNS)


PAIR = runtime(condition("pair", forms=["the", "of"], max_token_distance=4, search_scope="sentence"), distance_match_combination_cap=1_000_000)


@query("""
, g AS (SELECT a.paragraph_id, a.sentence_id, a.token_no AS p0, b.token_no AS p1 FROM pos a JOIN pos b USING (sentence_id) WHERE a.normalized_form = 'the' AND b.normalized_form = 'of' AND abs(a.token_no - b.token_no) <= 4),
n AS (SELECT *, 'pair:' || sentence_id || ':' || row_number() OVER (PARTITION BY sentence_id ORDER BY abs(p0 - p1), least(p0, p1), greatest(p0, p1), p0, p1) AS match_group_id FROM g)
SELECT paragraph_id, sentence_id, p0 AS token_no, 'pair' AS condition_id, match_group_id, 'the' AS match_role FROM n UNION ALL SELECT paragraph_id, sentence_id, p1, 'pair', match_group_id, 'of' FROM n""")
def strict_groups(spark, d):
    return Corpus(spark, d).hits(PAIR).select(HIT_COLUMNS)


@query("SELECT sentence_id AS unit_id, count(*) FILTER (normalized_form = 'the') * count(*) FILTER (normalized_form = 'of') AS combination_count FROM pos GROUP BY 1 HAVING combination_count > 0")
def combination_counts(spark, d):
    c = Corpus(spark, d)
    return hits.combination_counts(positions.positioned(c.tokens_of(["the", "of"]), c.sentences, ["the", "of"]), list(PAIR.rules)).drop("rule_no")


#: Narrowest first, without the tokens of groups already taken: the sorted candidates folded into the list of taken ones.
GREEDY = "list_reduce(c, lambda a, x: CASE WHEN {taken} THEN a ELSE list_append(a, x) END, c[1:0])"


@query(f"""
, v AS (SELECT a.paragraph_id, a.sentence_id, list({{'p0': a.token_no, 'p1': b.token_no}} ORDER BY abs(a.token_no - b.token_no), least(a.token_no, b.token_no), greatest(a.token_no, b.token_no)) AS c
  FROM pos a JOIN pos b USING (sentence_id) WHERE a.normalized_form = 'the' AND b.normalized_form = 'of' AND abs(a.token_no - b.token_no) <= 4 GROUP BY 1, 2),
g AS (SELECT paragraph_id, sentence_id, {GREEDY.format(taken="len(list_filter(a, lambda y: y.p0 = x.p0 OR y.p1 = x.p1)) > 0")} AS t FROM v),
n AS (SELECT paragraph_id, sentence_id, unnest(t) AS x, 'pair:' || sentence_id || ':' || unnest(range(1, len(t) + 1)) AS match_group_id FROM g)
SELECT paragraph_id, sentence_id, x.p0 AS token_no, 'pair' AS condition_id, match_group_id, 'the' AS match_role FROM n UNION ALL SELECT paragraph_id, sentence_id, x.p1, 'pair', match_group_id, 'of' FROM n""")
def greedy_groups(spark, d):
    rules = runtime(condition("pair", forms=["the", "of"], max_token_distance=4, search_scope="sentence"), distance_matching_mode="approx")
    return Corpus(spark, d).hits(rules).select(HIT_COLUMNS)


@query(f"""
, k AS (SELECT paragraph_id, count(*) FILTER (normalized_form = 'the') * count(*) FILTER (normalized_form = 'of') * count(*) FILTER (normalized_form = 'and') AS n FROM pos GROUP BY 1),
w AS (SELECT paragraph_id, paragraph_token_position AS p, normalized_form AS f FROM pos WHERE normalized_form IN ('the', 'of', 'and')),
v0 AS (SELECT a.paragraph_id, a.p AS p0, b.p AS p1, c.p AS p2, least(a.p, b.p, c.p) AS s, greatest(a.p, b.p, c.p) AS e FROM w a JOIN w b ON a.paragraph_id = b.paragraph_id AND b.f = 'of' AND abs(a.p - b.p) <= 8
  JOIN w c ON a.paragraph_id = c.paragraph_id AND c.f = 'and' AND abs(a.p - c.p) <= 8 AND abs(b.p - c.p) <= 8 WHERE a.f = 'the'),
v AS (SELECT paragraph_id, list({{'p0': p0, 'p1': p1, 'p2': p2}} ORDER BY e - s, s, e, p0, p1, p2) AS c FROM v0 GROUP BY 1),
g AS (SELECT paragraph_id, CASE WHEN n <= 20 THEN c ELSE {GREEDY.format(taken="len(list_filter(a, lambda y: y.p0 = x.p0 OR y.p1 = x.p1 OR y.p2 = x.p2)) > 0")} END AS t FROM v JOIN k USING (paragraph_id)),
n AS (SELECT paragraph_id, unnest(t) AS x, 'pair:' || paragraph_id || ':' || unnest(range(1, len(t) + 1)) AS match_group_id FROM g),
o AS (SELECT paragraph_id, x.p0 AS p, match_group_id FROM n UNION ALL SELECT paragraph_id, x.p1, match_group_id FROM n UNION ALL SELECT paragraph_id, x.p2, match_group_id FROM n)
SELECT paragraph_id, sentence_id, token_no, 'pair' AS condition_id, match_group_id, normalized_form AS match_role FROM o JOIN pos ON o.paragraph_id = pos.paragraph_id AND o.p = pos.paragraph_token_position""".replace("SELECT paragraph_id, sentence_id, token_no, 'pair'", "SELECT pos.paragraph_id, sentence_id, token_no, 'pair'"))
def capped_groups(spark, d):
    rules = runtime(condition("pair", forms=["the", "of", "and"], max_token_distance=8), distance_match_combination_cap=20)
    return Corpus(spark, d).hits(rules).select(HIT_COLUMNS)


@query(f"""
, f AS (SELECT a.paragraph_id, min(a.paragraph_token_position) AS p FROM pos a WHERE a.normalized_form = 'of'
  AND EXISTS (SELECT 1 FROM pos b WHERE b.paragraph_id = a.paragraph_id AND b.normalized_form = 'the' AND abs(b.paragraph_token_position - a.paragraph_token_position) <= 3)
  AND NOT EXISTS (SELECT 1 FROM pos b WHERE b.paragraph_id = a.paragraph_id AND b.normalized_form = 'in' AND abs(b.paragraph_token_position - a.paragraph_token_position) <= 3) GROUP BY 1),
c AS (SELECT DISTINCT paragraph_id FROM pos WHERE normalized_form = 'and')
SELECT paragraph_id, sentence_id, token_no, 'adv' AS condition_id, 'adv:g1:paragraph:' || paragraph_id AS match_group_id, normalized_form AS match_role FROM pos JOIN f USING (paragraph_id) JOIN c USING (paragraph_id) WHERE normalized_form IN ('of', 'the') AND abs(paragraph_token_position - p) <= 3
UNION ALL SELECT paragraph_id, sentence_id, token_no, 'adv', 'adv:g2:paragraph:' || paragraph_id, normalized_form FROM pos JOIN f USING (paragraph_id) WHERE normalized_form = 'and'""")
def advanced_group_hits(spark, d):
    rules = runtime(groups("adv", {"forms": ["of", "the"], "anchor_form": "of", "max_token_distance": 3, "exclude_forms_any": ["in"]}, {"forms": ["and"], "combine_logic": "and"}))
    return Corpus(spark, d).hits(rules).select(HIT_COLUMNS)


# ---------------------------------------------------------------- rendering
TA = f", {SIMPLE_SQL}, ta AS (SELECT paragraph_id, sentence_id, token_no, string_agg(condition_id, ',' ORDER BY match_group_id) AS c, string_agg(CASE condition_id WHEN 's1' THEN 'x' ELSE 'y' END, ',' ORDER BY match_group_id) AS k, string_agg(match_group_id, ',' ORDER BY match_group_id) AS g, count(*) AS n FROM h GROUP BY ALL)"


@query(TA + " SELECT paragraph_id, sentence_id, token_no, c AS condition_ids_text, k AS categories_text, g AS groups_text, n AS annotation_count FROM ta")
def token_annotations(spark, d):
    t = render.token_annotations(Corpus(spark, d).hits(SIMPLE))
    return t.select("paragraph_id", "sentence_id", "token_no", F.array_join("condition_ids", ",").alias("condition_ids_text"), F.array_join("categories", ",").alias("categories_text"), F.array_join("match_group_ids", ",").alias("groups_text"), "annotation_count")


TAGGED = TA + """, r AS (SELECT t.*, c, CASE WHEN c IS NULL THEN surface ELSE '[[HIT condition_ids="' || c || '" categories="' || k || '" groups="' || g || '"]]' || surface || '[[/HIT]]' END AS tagged, CASE WHEN c IS NULL THEN 0 ELSE 1 END AS hit FROM tok t LEFT JOIN ta USING (paragraph_id, sentence_id, token_no))"""


@query(TAGGED + " SELECT paragraph_id, sentence_id, string_agg(surface, '' ORDER BY token_no) AS sentence_text, string_agg(tagged, '' ORDER BY token_no) AS sentence_text_tagged, sum(hit)::BIGINT AS annotated_token_count FROM r GROUP BY 1, 2")
def rendered_sentences(spark, d):
    c = Corpus(spark, d)
    return render.rendered_sentences(c.lists, render.token_annotations(c.hits(SIMPLE))).select("paragraph_id", "sentence_id", "sentence_text", "sentence_text_tagged", "annotated_token_count")


@query(TAGGED + " SELECT paragraph_id, string_agg(surface, '' ORDER BY sentence_id, token_no) AS paragraph_text, string_agg(tagged, '' ORDER BY sentence_id, token_no) AS paragraph_text_tagged, sum(hit)::BIGINT AS annotated_token_count FROM r GROUP BY 1")
def rendered_paragraphs(spark, d):
    c = Corpus(spark, d)
    return render.rendered_paragraphs(c.lists, render.token_annotations(c.hits(SIMPLE))).select("paragraph_id", "paragraph_text", "paragraph_text_tagged", "annotated_token_count")


@query(TAGGED + """, o AS (SELECT *, sum(hit) OVER (PARTITION BY paragraph_id ORDER BY sentence_id, token_no ROWS UNBOUNDED PRECEDING) AS k FROM r),
 sg AS (SELECT paragraph_id, 2 * k + 1 - hit AS place, hit, string_agg(surface, '' ORDER BY sentence_id, token_no) AS text, max(c) AS ids FROM o GROUP BY 1, 2, 3)
 SELECT paragraph_id, row_number() OVER (PARTITION BY paragraph_id ORDER BY place) - 1 AS n, text, hit = 1 AS is_hit, coalesce(ids, '') AS condition_ids_text FROM sg""")
def parse_tagged(spark, d):
    c = Corpus(spark, d)
    tagged = render.rendered_paragraphs(c.lists, render.token_annotations(c.hits(SIMPLE)))
    return tagged.select("paragraph_id", F.posexplode(render.parse_tagged("paragraph_text_tagged")).alias("n", "s")).select("paragraph_id", "n", "s.text", "s.is_hit", F.coalesce(F.col("s.attributes")["condition_ids"], F.lit("")).alias("condition_ids_text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def escaped_html(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", html_escape(F.col("html")).alias("escaped"))


@query(f"SELECT paragraph_id, '[adv]' || chr(10) || 'g1: and forms=[the, of] scope=paragraph' || chr(10) || 'g2: and not absent=[in] in all 1 paragraphs' AS form_group_explanations_text FROM (({A}) EXCEPT ({has_any('in')}))")
def form_group_explanations(spark, d):
    rules = runtime(groups("adv", {"forms": ["the", "of"]}, {"forms": ["in"], "match_logic": "not", "combine_logic": "and"}))
    return render.explanations(Corpus(spark, d).evaluate(rules).condition_eval(), rules).select("paragraph_id", "form_group_explanations_text")


EXPORT_RULES = (condition("a", ["x"], forms=["the", "of"], annotation_filters=[{"namespace": "label", "key": "quality", "value": "1"}]),)


def _export(spark, d) -> DataFrame:
    c = Corpus(spark, d)
    rules = runtime(*EXPORT_RULES)
    e = c.evaluate(rules)
    chosen = select.select_paragraphs(e)
    rendered = render.rendered_paragraphs(c.lists.join(chosen.select("paragraph_id"), "paragraph_id", "left_semi"), render.token_annotations(c.hits(rules)))
    return output.paragraph_export(output.enriched_paragraphs(rendered, chosen, c.paragraphs, c.documents, render.explanations(e.condition_eval(), rules), c.annotations))


EXPORT_SQL = f", m AS (({A}) INTERSECT SELECT paragraph_id FROM ann WHERE label_key = 'quality' AND label_value = '1'), s AS (SELECT paragraph_id, string_agg(label_namespace || ':' || label_key || '=' || label_value, chr(10) ORDER BY label_key) AS pairs, count(*) AS n FROM ann GROUP BY 1)"


@query(EXPORT_SQL + " SELECT paragraph_id, par.document_id, category1, category2, 'a' AS matched_condition_ids_text, 'x' AS matched_categories_text, (SELECT count(*) FROM pos WHERE pos.paragraph_id = m.paragraph_id AND normalized_form IN ('the', 'of')) AS annotated_token_count, n AS manual_annotation_count, pairs AS manual_annotation_pairs_text, 'label' AS manual_annotation_namespaces_text FROM m JOIN par USING (paragraph_id) JOIN doc ON doc.document_id = par.document_id JOIN s USING (paragraph_id)")
def enriched_export(spark, d):
    return _export(spark, d).select("paragraph_id", "document_id", "category1", "category2", "matched_condition_ids_text", "matched_categories_text", "annotated_token_count", "manual_annotation_count", "manual_annotation_pairs_text", "manual_annotation_namespaces_text")


@query(EXPORT_SQL + " SELECT m.paragraph_id::VARCHAR AS paragraph_id, par.document_id::VARCHAR AS document_id, category1, category2, 'a' AS matched_condition_ids_text, 'x' AS matched_categories_text, '2' AS manual_annotation_count FROM m JOIN par USING (paragraph_id) JOIN doc ON doc.document_id = par.document_id")
def gui_records(spark, d):
    return output.gui_records(_export(spark, d)).select("paragraph_id", "document_id", "category1", "category2", "matched_condition_ids_text", "matched_categories_text", "manual_annotation_count")


def _session(spark, d) -> Session:
    c = Corpus(spark, d)
    # the sentences have their paragraphs' flags already
    return Session(c.tokens, c.sentences, c.paragraphs.drop("is_table_paragraph"), c.documents, lists=c.lists, tokens_of=c.tokens_of)


SENTENCE_SQL = f""", sm AS (SELECT sentence_id FROM ({_S})), pm AS ({B_}),
 se AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY paragraph_no, sentence_no_in_paragraph) AS sentence_no_in_document, sentence_id IN (SELECT * FROM sm) AS s, paragraph_id IN (SELECT * FROM pm) AS p FROM sen),
 sx2 AS (SELECT se.sentence_id, se.paragraph_id, se.document_id, category1, category2, sentence_no_in_paragraph, sentence_no_in_document, string_agg(surface, '' ORDER BY token_no) AS sentence_text,
  CASE WHEN s AND p THEN 'p, s' WHEN s THEN 's' ELSE 'p' END AS matched_condition_ids_text, CASE WHEN s AND p THEN 'c, q' WHEN s THEN 'c' ELSE 'q' END AS matched_categories_text,
  count(*) FILTER ((s AND normalized_form IN ('the', 'of')) OR (p AND normalized_form = 'and')) AS annotated_token_count
  FROM se JOIN doc USING (document_id) JOIN (SELECT sentence_id, token_no, surface, normalized_form FROM tok) USING (sentence_id) WHERE s OR p GROUP BY ALL)"""
SENTENCE_EXPORT = ["sentence_id", "paragraph_id", "document_id", "category1", "category2", "sentence_no_in_paragraph", "sentence_no_in_document", "sentence_text", "matched_condition_ids_text", "matched_categories_text", "annotated_token_count"]


@query(SENTENCE_SQL + f" SELECT {', '.join(SENTENCE_EXPORT)} FROM sx2")
def sentence_export(spark, d):
    return _session(spark, d).analyze(runtime(*SENTENCE_RULES, analysis_unit="sentence")).export.select(SENTENCE_EXPORT)


@query(SENTENCE_SQL + " SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in SENTENCE_EXPORT) + " FROM sx2")
def sentence_records(spark, d):
    return output.gui_records(_session(spark, d).analyze(runtime(*SENTENCE_RULES, analysis_unit="sentence")).export).select(SENTENCE_EXPORT)


REFERENCE_RULES = (
    groups("a", {"forms": ["the", "of"], "search_scope": "sentence"}, scope="sentence"),
    groups("b", {"forms": ["and"], "search_scope": "sentence"}, scope="sentence", required_condition_ids_all=["a"]),
    condition("p", ["q"], forms=["to"], required_categories_any=["c"]),
)
REFERENCES = f""", ra AS ({_S}), rb AS (SELECT DISTINCT sentence_id FROM pos WHERE normalized_form = 'and' AND sentence_id IN (SELECT * FROM ra)),
 rp AS (SELECT sentence_id FROM cnt WHERE paragraph_id IN ({has_any('to')}) AND paragraph_id IN (SELECT paragraph_id FROM pos WHERE sentence_id IN (SELECT * FROM ra))),
 rt AS (SELECT sentence_id, 'a' AS condition_id FROM ra UNION ALL SELECT sentence_id, 'b' FROM rb UNION ALL SELECT sentence_id, 'p' FROM rp)"""


@query(REFERENCES + " SELECT sentence_id, string_agg(condition_id, ', ' ORDER BY condition_id) AS matched_condition_ids_text FROM rt GROUP BY 1")
def sentence_mode_references(spark, d):
    c = Corpus(spark, d)
    return select.SentenceSelection(c.evaluate(runtime(*REFERENCE_RULES, analysis_unit="sentence")), c.tokens).sentences().select("sentence_id", "matched_condition_ids_text")


@query(REFERENCES + " SELECT pos.sentence_id, token_no, condition_id FROM pos JOIN rt USING (sentence_id) WHERE (condition_id = 'a' AND normalized_form IN ('the', 'of')) OR (condition_id = 'b' AND normalized_form = 'and') OR (condition_id = 'p' AND normalized_form = 'to')")
def hits_by_truth(spark, d):
    c = Corpus(spark, d)
    rules = runtime(*REFERENCE_RULES, analysis_unit="sentence")
    selection = select.SentenceSelection(c.evaluate(rules), c.tokens)
    truth = selection.rows.select("sentence_id", F.explode(evaluate.matched_ids(selection.e.data, F.col("truth"))).alias("condition_id"))
    return c.hits(rules).join(truth, ["sentence_id", "condition_id"], "left_semi").select("sentence_id", "token_no", "condition_id")


@query(f"""
, l AS (SELECT paragraph_id, min(paragraph_token_position) AS s, max(paragraph_token_position) AS e FROM pos WHERE normalized_form IN ('the', 'of') AND paragraph_id IN ({A}) GROUP BY 1),
r AS (SELECT paragraph_id, min(paragraph_token_position) AS s, max(paragraph_token_position) AS e FROM pos WHERE normalized_form IN ('and', 'der') GROUP BY 1),
b AS (SELECT coalesce(l.paragraph_id, r.paragraph_id) AS paragraph_id, CASE WHEN r.s IS NULL OR (l.s IS NOT NULL AND (l.s, l.e) <= (r.s, r.e)) THEN 1 ELSE 2 END AS g FROM l FULL JOIN r USING (paragraph_id))
SELECT pos.paragraph_id, sentence_id, token_no, 'o' AS condition_id, 'o:g' || g || ':paragraph:' || pos.paragraph_id AS match_group_id, normalized_form AS match_role
FROM pos JOIN b ON pos.paragraph_id = b.paragraph_id WHERE (g = 1 AND normalized_form IN ('the', 'of')) OR (g = 2 AND normalized_form IN ('and', 'der'))""")
def or_group_hits(spark, d):
    return Corpus(spark, d).hits(runtime(groups("o", {"forms": ["the", "of"]}, {"forms": ["and", "der"], "match_logic": "or", "combine_logic": "or"}))).select(HIT_COLUMNS)


@query("SELECT paragraph_id, '[x]' || chr(10) || 'tg1: and texts=[tion, the] scope=paragraph' || chr(10) || 'tg2: and not texts=[|] scope=sentence' AS text_group_explanations_text, 'x: text_groups mixed-scope promoted to paragraph (paragraph + sentence)' AS mixed_scope_warning_text FROM (SELECT paragraph_id, string_agg(sentence_text, '' ORDER BY sentence_no_in_paragraph) AS t, bool_or(NOT contains(sentence_text, '|')) AS n FROM sen GROUP BY 1) WHERE contains(t, 'tion') AND contains(t, 'the') AND n")
def text_group_explanations(spark, d):
    rules = runtime(condition("x", text_groups=[{"texts": ["tion", "the"], "search_scope": "paragraph"}, {"texts": ["|"], "match_logic": "not", "combine_logic": "and", "search_scope": "sentence"}]))
    return render.explanations(Corpus(spark, d).evaluate(rules).condition_eval(), rules).select("paragraph_id", "text_group_explanations_text", "mixed_scope_warning_text")


# ---------------------------------------------------------------- annotations, facets, neighbours
@query("SELECT paragraph_id, count(*) AS manual_annotation_count, string_agg(label_namespace || ':' || label_key || '=' || label_value, chr(10) ORDER BY label_key) AS manual_annotation_pairs_text, 'label' AS manual_annotation_namespaces_text FROM ann GROUP BY 1")
def annotation_summary(spark, d):
    return output.annotation_summary(Corpus(spark, d).annotations)


@query(", x AS (SELECT document_id % 97 AS paragraph_id, 'doc' AS label_namespace, category2 AS label_key, category1 AS label_value FROM doc), n AS (SELECT 'annotation_duplicate_deduplicated' AS code, paragraph_id, label_namespace, label_key, label_value AS values_text, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1) SELECT * FROM n UNION ALL SELECT 'annotation_value_conflict', paragraph_id, label_namespace, label_key, string_agg(DISTINCT label_value, ', ' ORDER BY label_value), count(DISTINCT label_value) FROM x GROUP BY 2, 3, 4 HAVING count(DISTINCT label_value) > 1")
def annotation_conflicts(spark, d):
    docs = Corpus(spark, d).documents
    return output.annotation_issues(docs.select((F.col("document_id") % 97).alias("paragraph_id"), F.lit("doc").alias("label_namespace"), F.col("category2").alias("label_key"), F.col("category1").alias("label_value")))


FACET_RULES = (condition("a", ["x", "z"], forms=["the", "of"]), condition("b", ["y"], forms=["and"]))
FACET_SQL = f", m AS (SELECT paragraph_id, string_agg(c, ', ' ORDER BY c) AS matched_condition_ids_text FROM (SELECT paragraph_id, 'a' AS c FROM ({A}) UNION ALL SELECT paragraph_id, 'b' FROM ({B_})) GROUP BY 1), r AS (SELECT m.*, category1, category2, CASE matched_condition_ids_text WHEN 'a' THEN 'x, z' WHEN 'b' THEN 'y' ELSE 'x, y, z' END AS matched_categories_text FROM m JOIN par USING (paragraph_id) JOIN doc ON doc.document_id = par.document_id)"


def _facet_records(spark, d) -> DataFrame:
    c = Corpus(spark, d)
    return select.select_paragraphs(c.evaluate(runtime(*FACET_RULES))).join(c.paragraphs.select("paragraph_id", "document_id"), "paragraph_id").join(c.documents.select("document_id", "category1", "category2"), "document_id")


@query(FACET_SQL + " SELECT 'category1' AS facet, category1 AS value, count(*) AS count FROM r GROUP BY 2 UNION ALL SELECT 'category2', category2, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'matched_condition_ids_text', v, count(*) FROM (SELECT unnest(string_split(matched_condition_ids_text, ', ')) AS v FROM r) GROUP BY 2 UNION ALL SELECT 'matched_categories_text', v, count(*) FROM (SELECT unnest(string_split(matched_categories_text, ', ')) AS v FROM r) GROUP BY 2")
def facet_counts(spark, d):
    return output.facet_counts(_facet_records(spark, d), {"category1": False, "category2": False, "matched_condition_ids_text": True, "matched_categories_text": True})


@query(FACET_SQL + " SELECT paragraph_id, matched_condition_ids_text FROM r WHERE category2 IN ('en', 'de') AND list_contains(string_split(matched_condition_ids_text, ', '), 'b')")
def facet_filter(spark, d):
    return output.facet_filter(_facet_records(spark, d), {"category2": ["en", "de"], "matched_condition_ids_text": ["b"], "category1": []}).select("paragraph_id", "matched_condition_ids_text")


@query(FACET_SQL + " SELECT category1 AS value, count(*) AS count FROM r WHERE contains(lower(category1), 'src1') GROUP BY 1")
def facet_search(spark, d):
    return output.facet_search(output.facet_counts(_facet_records(spark, d), {"category1": False}), " SRC1 ").select("value", "count")


def _turns(spark, d) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("paragraph_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("paragraph_no"), F.col("text").alias("paragraph_text"))


@query("SELECT c.conv_id * 1000 + c.turn AS center_id, p.turn AS paragraph_no, p.text AS paragraph_text, p.turn = c.turn AS is_center FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn BETWEEN greatest(c.turn - 2, 1) AND c.turn + 2 WHERE c.role = 'assistant'")
def paragraph_context(spark, d):
    wanted = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("paragraph_id"))
    return output.paragraph_context(_turns(spark, d), wanted).select("center_id", "paragraph_no", "paragraph_text", "is_center")


@query("SELECT c.conv_id * 1000 + c.turn AS center_id, max(p.turn) FILTER (p.turn < c.turn) AS previous_no, min(p.turn) FILTER (p.turn > c.turn) AS next_no FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn BETWEEN greatest(c.turn - 2, 1) AND c.turn + 2 GROUP BY 1")
def neighbour_locations(spark, d):
    turns = _turns(spark, d)
    return output.neighbours(output.paragraph_context(turns, turns.select("paragraph_id")))


# ---------------------------------------------------------------- counts of groups, summaries of both grains
COUNTED = runtime(
    groups("or window", {"forms": ["to", "that"], "match_logic": "or", "max_token_distance": 3, "exclude_forms_any": ["the"]}),
    groups("and window", {"forms": ["of", "the", "and"], "anchor_form": "of", "max_token_distance": 5}, {"forms": ["in", "to", "is", "that"], "match_logic": "or", "combine_logic": "and"}),
    groups("mixed", {"forms": ["the", "of"], "search_scope": "sentence"}, {"forms": ["and", "in", "to"], "match_logic": "or", "combine_logic": "and", "search_scope": "paragraph"}),
    groups("not", {"forms": ["the"]}, {"forms": ["in", "to"], "match_logic": "not", "combine_logic": "and"}),
    groups("by sentence", {"forms": ["der", "die"], "match_logic": "or", "search_scope": "sentence"}, {"forms": ["und"], "match_logic": "not", "combine_logic": "or", "search_scope": "sentence"}, scope="sentence"),
)


def _present(forms: str, unit: str = "paragraph_id", least: int = 1) -> str:
    return f"SELECT paragraph_id, {unit} AS u, count(DISTINCT normalized_form) AS n FROM pos WHERE normalized_form IN ({forms}) GROUP BY 1, 2 HAVING n >= {least}"


_WITHIN = "EXISTS (SELECT 1 FROM pos b WHERE b.paragraph_id = a.paragraph_id AND b.normalized_form = '{f}' AND abs(b.paragraph_token_position - a.paragraph_token_position) <= 3)"


@query(f"""
, oa AS (SELECT a.*, {_WITHIN.format(f="to")}::INT + {_WITHIN.format(f="that")}::INT AS n, row_number() OVER (PARTITION BY paragraph_id ORDER BY normalized_form = 'that', paragraph_token_position) AS k
         FROM pos a WHERE normalized_form IN ('to', 'that') AND NOT {_WITHIN.format(f="the")}),
aw AS ({around("of", ("of", "the", "and"), 5)}), wi AS ({_present("'in', 'to', 'is', 'that'")}),
ms AS (SELECT DISTINCT paragraph_id FROM ({_present("'the', 'of'", "sentence_id", 2)})), mp AS ({_present("'and', 'in', 'to'")}),
sd AS ({_present("'der', 'die'", "sentence_id")}), su AS (SELECT DISTINCT sentence_id FROM pos WHERE normalized_form = 'und')
SELECT 'or window' AS condition_id, paragraph_id, 'paragraph' AS unit_scope, paragraph_id AS unit_id, n::BIGINT AS matched_form_count, true AS distance_is_match FROM oa WHERE k = 1
UNION ALL SELECT 'and window', paragraph_id, 'paragraph', paragraph_id, greatest(3, n), true FROM aw JOIN wi USING (paragraph_id)
UNION ALL SELECT 'mixed', paragraph_id, 'paragraph', paragraph_id, greatest(2, n), true FROM ms JOIN mp USING (paragraph_id)
UNION ALL SELECT 'not', paragraph_id, 'paragraph', paragraph_id, 2, true FROM ({has_any("the")} EXCEPT {has_any("in", "to")})
UNION ALL SELECT 'by sentence', sen.paragraph_id, 'sentence', sen.sentence_id, greatest(coalesce(n, 0), CASE WHEN su.sentence_id IS NULL THEN 1 ELSE 0 END), true
  FROM sen LEFT JOIN sd ON sd.u = sen.sentence_id LEFT JOIN su ON su.sentence_id = sen.sentence_id WHERE n IS NOT NULL OR su.sentence_id IS NULL""")
def group_counts(spark, d):
    c = Corpus(spark, d)
    return group_units.matched_units(positions.positioned(c.tokens_of(COUNTED.vocabulary), c.sentences, COUNTED.vocabulary), c.sentences.select("paragraph_id", "sentence_id"), list(COUNTED.rules))


NEEDING = runtime(condition("a", ["x", "z"], forms=["the", "of"]), condition("b", ["y"], forms=["and"], required_categories_all=["x"]), condition("c", ["y"], forms=["in"], required_categories_any=["q", "y"]), condition("d", ["w"], forms=["to"], required_categories_any=["q"]))


@query(f""", h AS (SELECT p.*, c, k FROM pos p JOIN (SELECT paragraph_id, 'a' AS c, ['the', 'of'] AS f, ['x'] AS k FROM ({has_all("the", "of")}) UNION ALL SELECT paragraph_id, 'b', ['and'], ['y'] FROM ({has_any("and")})
  UNION ALL SELECT paragraph_id, 'c', ['in'], ['y'] FROM ({has_any("in")})) m ON m.paragraph_id = p.paragraph_id AND list_contains(f, normalized_form))
SELECT paragraph_id, sentence_id, token_no, c AS condition_id FROM h WHERE c IN ('a', 'c') OR paragraph_id IN ({has_all("the", "of")})""")
def hits_by_category(spark, d):
    found = Corpus(spark, d).hits(NEEDING)
    return hits.by_categories(found, list(NEEDING.rules)).select("paragraph_id", "sentence_id", "token_no", "condition_id")


BOTH_GRAINS = (groups("s", {"forms": ["the", "of"], "search_scope": "sentence"}, scope="sentence"), condition("p", ["q", "r"], forms=["and"]), condition("never", ["n"], forms=["xyzzy"]))


@query(f""", sp AS (SELECT DISTINCT paragraph_id, 's' AS c, ['c'] AS k FROM pos WHERE sentence_id IN ({_S}) UNION ALL SELECT paragraph_id, 'p', ['q', 'r'] FROM ({B_})),
u AS (SELECT DISTINCT paragraph_id FROM pos WHERE normalized_form IN ('the', 'of', 'and', 'xyzzy'))
SELECT u.paragraph_id, 3::BIGINT AS condition_count, count(c) AS matched_condition_count, count(c) > 0 AS is_selected, coalesce(string_agg(c, ', ' ORDER BY c), '') AS matched_condition_ids_text,
  array_to_string(list_sort(list_distinct(flatten(coalesce(list(k) FILTER (c IS NOT NULL), [])))), ', ') AS matched_categories_text FROM u LEFT JOIN sp USING (paragraph_id) GROUP BY 1""")
def detail_summary(spark, d):
    c, rules = Corpus(spark, d), runtime(*BOTH_GRAINS, analysis_unit="sentence")
    e = c.evaluate(rules)
    rows = select.SentenceSelection(e, c.tokens).rows
    truth = rows.select("paragraph_id", F.explode(evaluate.matched_ids(e.data, F.col("truth"))).alias("condition_id"))
    return select.detail_summary(e.condition_eval(), truth, {r.id: r.categories for r in rules.rules})


@query(f""", si AS (SELECT DISTINCT sentence_id FROM pos WHERE sentence_id IN ({_S})), pi AS ({B_}),
u AS (SELECT DISTINCT paragraph_id FROM pos WHERE normalized_form IN ('the', 'of', 'and'))
SELECT sen.sentence_id, sen.paragraph_id, (CASE WHEN si.sentence_id IS NULL THEN 0 ELSE 1 END + CASE WHEN u.paragraph_id IS NULL THEN 0 ELSE 2 END)::BIGINT AS condition_count,
  (CASE WHEN si.sentence_id IS NULL THEN 0 ELSE 1 END + CASE WHEN pi.paragraph_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS matched_condition_count, si.sentence_id IS NOT NULL OR pi.paragraph_id IS NOT NULL AS is_selected,
  concat_ws(', ', CASE WHEN pi.paragraph_id IS NULL THEN NULL ELSE 'p' END, CASE WHEN si.sentence_id IS NULL THEN NULL ELSE 's' END) AS matched_condition_ids_text,
  concat_ws(', ', CASE WHEN si.sentence_id IS NULL THEN NULL ELSE 'c' END, CASE WHEN pi.paragraph_id IS NULL THEN NULL ELSE 'q' END) AS matched_categories_text
FROM sen LEFT JOIN si USING (sentence_id) LEFT JOIN pi ON pi.paragraph_id = sen.paragraph_id LEFT JOIN u ON u.paragraph_id = sen.paragraph_id""")
def inherited_summary(spark, d):
    c = Corpus(spark, d)
    own = hits.locate(positions.positioned(c.tokens_of(["the", "of"]), c.sentences, ["the", "of"]), runtime(SENTENCE_RULES[0])).rows.select("sentence_id").distinct()
    summary = own.select("sentence_id", F.lit(1).alias("condition_count"), F.lit(True).alias("is_selected"), F.array(F.lit("s")).alias("condition_ids"), F.array(F.lit("c")).alias("categories"))
    e = c.evaluate(runtime(SENTENCE_RULES[1], condition("a", forms=["the", "of"])))
    matched = F.filter("matched", lambda r: r == 0)
    above = e.paragraph_rows.select("paragraph_id", F.lit(2).alias("condition_count"), (F.size(matched) > 0).alias("is_selected"), evaluate.matched_ids(e.data, matched).alias("condition_ids"), evaluate.matched_categories(e.data, matched).alias("categories"))
    return select.inherited(c.sentences, summary, above)


# ---------------------------------------------------------------- dictionary tokens; tests hold the path against all segmentations
@query()
def dictionary_tokens(spark, d):
    """Documents by a dictionary of the benchmark's words and of their beginnings: frequent and long ones are cheap."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    pieces = words.select(F.explode(F.array_distinct(F.array("w", F.substring("w", 1, 3), F.substring("w", 1, 5)))).alias("surface"))
    cost = 4000 - 300 * F.least(F.lit(10), F.floor(F.log2("n"))) - 200 * F.least(F.lit(8), F.length("surface"))
    entries = pieces.groupBy("surface").agg(F.count(F.lit(1)).alias("n")).select("surface", cost.cast("long").alias("cost"), F.array(F.when(F.length("surface") > 3, F.lit("long")).otherwise(F.lit("short"))).alias("pos"))
    connections = spark.createDataFrame([("short", "short", 800), ("long", "short", 100), ("unknown", "unknown", 50)], "left string, right string, cost int")
    tokens = lattice.dictionary_tokens(Corpus(spark, d).sentences, entries, connections)
    return tokens.select("sentence_id", "token_no", "surface", "normalized_form", "pos1", "pos2", "is_oov")
