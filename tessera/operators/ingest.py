"""From texts to paragraphs, sentences and tokens.

Ids are made of their parents' (paragraph = document * 100000 + number, sentence = paragraph * 10000 + number), so they
are stable under repartitioning and need no global numbering.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import let, uni_trim

#: Sentence ends, closing marks, and bracket pairs.
ENDS = "。．.!?！？"
CLOSERS = "」』）)]】〉》\"'"
BRACKETS = {"(": ")", "（": "）", "「": "」", "『": "』", "【": "】", "［": "］", "〈": "〉", "《": "》"}

_END = "[" + re.escape(ENDS) + "]"
_NOT_END = "[^" + re.escape(ENDS) + "]"
SENTENCE = f"{_NOT_END}*{_END}[{re.escape(CLOSERS)}]*|{_NOT_END}+$"
#: The same for texts without a wide end: Java takes many times as long for a class that has wide characters.
WIDE_ENDS = [c for c in ENDS if not c.isascii()]
NARROW_SENTENCE = rf"[^.!?]*[.!?][{re.escape(CLOSERS)}]*|[^.!?]+$"
TOKEN = r"[^ .,!?]+"
PARAGRAPH_STEP, SENTENCE_STEP = 100_000, 10_000


def numbered(parent: Column, number: Column, step: int, what: str) -> Column:
    """An id made of its parent's; a number that reaches the step is an error, as ids would no longer be unique."""
    message = F.concat(F.lit(f"{what}: at most {step - 1} under one id, found "), number.cast("string"), F.lit(" under "), parent.cast("string"))
    return F.when(number < step, parent * step + number).otherwise(F.raise_error(message).cast("long"))


def clean_newlines(c: Column) -> Column:
    return uni_trim(F.regexp_replace(c, "\r\n?", "\n"))


def paragraph_blocks(text: Column) -> Column:
    """Texts of the paragraphs: blocks between blank lines if there is a blank line, else lines."""

    def blocks(lines: Column) -> Column:
        return F.when(F.array_contains(lines, ""), F.split(F.array_join(lines, "\n"), "\n{2,}")).otherwise(lines)

    return F.filter(let(F.transform(F.split(clean_newlines(text), "\n"), uni_trim), blocks), lambda v: v != "")


# ---------------------------------------------------------------- pipe tables
PIPE = re.compile(r"(?:[^\\|]|\\.)*")


def cells(line: str) -> list[str]:
    """Cells of a table row; a backslash takes the meaning from the next character."""
    row = line.strip()
    if not row:
        return []
    parts, at = [], 0
    while True:
        m = PIPE.match(row, at)
        end = m.end() if m.end() < len(row) and row[m.end()] == "|" else len(row)
        parts.append(row[at:end].strip())
        if end >= len(row):
            break
        at = end + 1
    if len(parts) == 1:
        return parts
    if row.startswith("|"):
        parts = parts[1:]
    return parts[:-1] if row.endswith("|") and parts else parts


def has_pipe(line: str) -> bool:
    m = PIPE.match(line)
    return m.end() < len(line) and line[m.end()] == "|"


def is_rule(line: str) -> bool:
    return has_pipe(line.strip()) and bool(c := cells(line)) and all(re.fullmatch(r":?-{2,}:?", x) for x in c)


def row_and_rest(line: str) -> tuple[str, str]:
    """A row that begins with a pipe, and what stands behind its last pipe."""
    row = line.strip()
    if not row.startswith("|"):
        return row, ""
    last = at = 0
    while (m := PIPE.match(row, at)).end() < len(row) and row[m.end()] == "|":
        last, at = m.end(), m.end() + 1
    return row[: last + 1].rstrip(), row[last + 1 :].strip()


def table_blocks(text: str) -> Iterator[tuple[str, int, int | None, int, int]]:
    """Paragraphs with tables kept together: (text, is table, columns, parse error, trailing text was detached)."""
    lines = [x.strip() for x in re.sub("\r\n?", "\n", text).strip().split("\n")]
    if lines == [""]:
        return
    joins = "" in lines
    plain: list[str] = []
    rows: list[str] = []
    columns, detached = None, 0

    def close_plain():
        if plain:
            yield "\n".join(plain), 0, None, 0, 0
            plain.clear()

    def close_table():
        nonlocal detached
        if rows:
            wrong = any(not has_pipe(r) or len(cells(r)) != columns for r in rows)
            yield "\n".join(rows), 1, columns, int(wrong), detached
            rows.clear()
            detached = 0

    def add_plain(line: str):
        if not joins:
            yield from close_plain()
        plain.append(line)

    for line in lines:
        if not line:
            yield from close_table()
            yield from close_plain()
        elif is_rule(line):
            source = rows or plain
            header = source.pop() if source and has_pipe(source[-1]) and not (rows and is_rule(rows[-1])) else None
            yield from close_table() if source is rows else close_plain()
            rows.extend([header, line] if header is not None else [line])
            columns, detached = len(cells(line)), 0
        elif rows and has_pipe(line):
            row, rest = row_and_rest(line)
            rows.append(row)
            if rest:
                detached = 1
                yield from close_table()
                yield from add_plain(rest)
        else:
            yield from close_table()
            yield from add_plain(line)
    yield from close_table()
    yield from close_plain()


BLOCK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("is_table", "columns", "error", "detached"))]))
#: Texts that are Python objects at a time.
TEXTS = 256


@F.arrow_udf(BLOCK)
def table_paragraph_blocks(texts: pa.Array) -> pa.Array:
    names = ("text", "is_table", "columns", "error", "detached")
    kind = pa.list_(pa.struct([("text", pa.string()), *((n, pa.int64()) for n in names[1:])]))

    def blocks(some: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, b)) for b in table_blocks(t)] if t else [] for t in some.to_pylist()], kind)

    return pa.concat_arrays([blocks(texts.slice(k, TEXTS)) for k in range(0, max(len(texts), 1), TEXTS)])


# ---------------------------------------------------------------- sentences
def bracketed_sentences(text: str) -> list[str]:
    """Sentences of one paragraph; ends inside brackets don't count, closing marks stay with their sentence."""
    opened_by = {b: a for a, b in BRACKETS.items()}
    text = text.strip()
    out, stack, begin, i = [], [], 0, 0
    while i < len(text):
        ch = text[i]
        i += 1
        if ch in BRACKETS:
            stack.append(ch)
        elif ch in opened_by and opened_by[ch] in stack:  # closes the nearest such bracket and all inside it
            while stack.pop() != opened_by[ch]:
                pass
        if ch in ENDS and not stack:
            while i < len(text) and text[i] in CLOSERS:
                i += 1
            out.append(text[begin:i].strip())
            begin = i
    out.append(text[begin:].strip())
    return [s for s in out if s]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bracketed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bracketed_sentences(t) if t is not None else None)


def sentence_texts(paragraph: Column, inside_brackets: bool = True) -> Column:
    """Sentences of a paragraph; a paragraph without a sentence is one itself.

    With ``inside_brackets`` ends inside brackets part sentences too, and all is one regular expression; otherwise
    only paragraphs that hold a bracket go through Python.
    """
    wide = reduce(or_, (paragraph.contains(c) for c in WIDE_ENDS))
    found, narrow = (F.regexp_extract_all(paragraph, F.lit(p), F.lit(0)) for p in (SENTENCE, NARROW_SENTENCE))
    plain = F.filter(F.transform(F.when(wide, found).otherwise(narrow), uni_trim), lambda v: v != "")
    if not inside_brackets:
        has = paragraph.rlike("[" + re.escape("".join(BRACKETS)) + "]")
        plain = F.coalesce(_bracketed(F.when(has, paragraph)), plain)
    return let(plain, lambda found: F.when(F.size(found) == 0, F.array(paragraph)).otherwise(found))


def table_sentences(paragraph: Column) -> Column:
    """Lines of a table, without its rule lines."""
    lines = F.filter(F.transform(F.split(paragraph, "\n"), uni_trim), lambda v: v != "")
    return F.filter(lines, lambda v: ~v.rlike(r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$") | ~v.contains("|"))


# ---------------------------------------------------------------- frames
def documents_frame(raw: DataFrame, id_col: str = "doc_id", text_col: str = "text", category1: str = "source", category2: str = "lang") -> DataFrame:
    """Documents with their statistics: SHA-256, characters, lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return raw.select(
        F.col(id_col).cast("long").alias("document_id"), F.coalesce(F.col(category1), F.lit("")).alias("category1"), F.coalesce(F.col(category2), F.lit("")).alias("category2"), text.alias("raw_text"),
        F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("char_count"),
        F.when(text == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("line_count"),
    )


def paragraphs_frame(documents: DataFrame, tables: bool = False) -> DataFrame:
    """One row per paragraph; with ``tables`` pipe tables are kept together and described."""
    if tables:
        exploded = documents.select("document_id", F.posexplode(table_paragraph_blocks("raw_text")).alias("n", "b"))
        cols = [F.col("b.text").alias("paragraph_text"), F.col("b.is_table").alias("is_table_paragraph"), F.col("b.columns").alias("table_column_count"), F.col("b.error").alias("table_parse_error"), F.col("b.detached").alias("table_trailing_text_detached")]
    else:
        exploded = documents.select("document_id", F.posexplode(paragraph_blocks(F.col("raw_text"))).alias("n", "t"))
        cols = [F.col("t").alias("paragraph_text"), F.lit(0).cast("long").alias("is_table_paragraph"), F.lit(None).cast("long").alias("table_column_count"), F.lit(0).cast("long").alias("table_parse_error"), F.lit(0).cast("long").alias("table_trailing_text_detached")]
    number = (F.col("n") + 1).cast("long")
    return exploded.select(numbered(F.col("document_id"), number, PARAGRAPH_STEP, "paragraphs").alias("paragraph_id"), "document_id", number.alias("paragraph_no"), *cols)


def sentences_frame(paragraphs: DataFrame, inside_brackets: bool = True) -> DataFrame:
    """One row per sentence, numbered in its paragraph; table paragraphs have a sentence per line."""
    texts = F.when(F.col("is_table_paragraph") == 1, table_sentences(F.col("paragraph_text"))).otherwise(sentence_texts(F.col("paragraph_text"), inside_brackets))
    number = (F.col("n") + 1).cast("long")
    return paragraphs.select("paragraph_id", "document_id", "paragraph_no", "is_table_paragraph", F.posexplode(texts).alias("n", "sentence_text")).select(
        numbered(F.col("paragraph_id"), number, SENTENCE_STEP, "sentences").alias("sentence_id"), "paragraph_id", "document_id", "paragraph_no", number.alias("sentence_no_in_paragraph"), "is_table_paragraph", "sentence_text"
    )


def numbered_sentences(documents: DataFrame, pattern: str | None = None) -> DataFrame:
    """Sentences of plain documents (ends inside brackets count, no tables) with ``sentence_no_in_document``, without a
    shuffle: a document's sentences are numbered while it is one row. With the ``pattern`` of tokens a sentence also has
    ``tokens_before``, the tokens of its paragraph that stand before it."""

    def before(texts: Column) -> Column:
        return F.aggregate(texts, F.array(F.lit(0).cast("long")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))))

    def of(texts: Column, starts: Column, i: Column) -> Column:
        return F.transform(texts, lambda s, j: F.struct((i + 1).cast("long").alias("p"), (j + 1).cast("long").alias("n"), s.alias("t"), (F.get(starts, j) if pattern else F.lit(0)).alias("b")))

    def sentences(p: Column, i: Column) -> Column:
        return let(sentence_texts(p), lambda texts: let(before(texts), lambda starts: of(texts, starts, i)) if pattern else of(texts, texts, i))

    inner = F.transform(paragraph_blocks(F.col("raw_text")), sentences)
    rows = documents.select("document_id", F.posexplode(F.flatten(inner)).alias("k", "x"))
    rows = rows.withColumn("paragraph_id", numbered(F.col("document_id"), F.col("x.p"), PARAGRAPH_STEP, "paragraphs"))
    return rows.select(
        numbered(F.col("paragraph_id"), F.col("x.n"), SENTENCE_STEP, "sentences").alias("sentence_id"), "paragraph_id", "document_id", F.col("x.p").alias("paragraph_no"),
        F.col("x.n").alias("sentence_no_in_paragraph"), F.lit(0).cast("long").alias("is_table_paragraph"), F.col("x.t").alias("sentence_text"), (F.col("k") + 1).cast("long").alias("sentence_no_in_document"),
        *([F.col("x.b").alias("tokens_before")] if pattern else []),
    )


def with_document_numbers(sentences: DataFrame) -> DataFrame:
    """Add ``sentence_no_in_document``."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("paragraph_no", "sentence_no_in_paragraph")
    return sentences.withColumn("sentence_no_in_document", F.row_number().over(order).cast("long"))


def tokens_frame(sentences: DataFrame, pattern: str = TOKEN, lossless: bool = False) -> DataFrame:
    """One row per token: surface and lower-case form. ``lossless`` tokens join to the sentence again."""
    pattern = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]" if lossless else pattern
    found = F.regexp_extract_all("sentence_text", F.lit(pattern), F.lit(0))
    return sentences.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", F.posexplode(found).alias("n", "surface")).select(
        "paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", (F.col("n") + 1).cast("long").alias("token_no"), F.lower("surface").alias("normalized_form"), "surface"
    )


def token_lists(sentences: DataFrame, pattern: str = TOKEN, lossless: bool = False) -> DataFrame:
    """Sentences of which the tokens are one list, ``surfaces``, in order; the numbers of the tokens are their places."""
    pattern = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]" if lossless else pattern
    return sentences.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", F.regexp_extract_all("sentence_text", F.lit(pattern), F.lit(0)).alias("surfaces"))


def tokens_of_sentences(sentences: DataFrame, forms: list[str] | None = None, pattern: str = TOKEN) -> DataFrame:
    """Tokens with their positions, of sentences that have ``tokens_before``: no shuffle. ``forms`` are looked for while
    a sentence is one row, so that other tokens never become rows."""
    found = F.transform(F.regexp_extract_all("sentence_text", F.lit(pattern), F.lit(0)), lambda s, j: F.struct((j + 1).cast("long").alias("n"), F.lower(s).alias("f"), s.alias("t")))
    if forms and all(f.isascii() for f in forms):
        # a sentence without any is not split. (Not for other forms, as lower case can depend on what stands around a letter.)
        low = F.lower("sentence_text")
        sentences = sentences.where(let(low, lambda x: F.exists(F.array(*map(F.lit, forms)), lambda f: x.contains(f))))
    found = found if forms is None else F.filter(found, lambda x: x["f"].isin(list(forms)))
    rows = sentences.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", "tokens_before", F.explode(found).alias("x"))
    return rows.select(
        "paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", F.col("x.n").alias("token_no"), F.col("x.n").alias("sentence_token_position"),
        (F.col("tokens_before") + F.col("x.n")).alias("paragraph_token_position"), F.col("x.f").alias("normalized_form"), F.col("x.t").alias("surface"),
    )


def positioned_tokens(paragraphs: DataFrame, pattern: str = TOKEN, inside_brackets: bool = True) -> DataFrame:
    """Tokens with their positions in sentence and paragraph, without a shuffle.

    While a paragraph is one row its sentences' tokens stand in one array; the place in that array is the position in
    the paragraph.
    """
    texts = F.when(F.col("is_table_paragraph") == 1, table_sentences(F.col("paragraph_text"))).otherwise(sentence_texts(F.col("paragraph_text"), inside_brackets))

    def tokens(text, i):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s, j: F.struct((i + 1).cast("long").alias("s"), (j + 1).cast("long").alias("n"), s.alias("t")))

    rows = paragraphs.select("paragraph_id", "is_table_paragraph", texts.alias("texts")).select("paragraph_id", "is_table_paragraph", F.posexplode(F.flatten(F.transform("texts", tokens))).alias("k", "x"))
    return rows.select(
        "paragraph_id", numbered(F.col("paragraph_id"), F.col("x.s"), SENTENCE_STEP, "sentences").alias("sentence_id"), F.col("x.s").alias("sentence_no_in_paragraph"), "is_table_paragraph", F.col("x.n").alias("token_no"),
        F.col("x.n").alias("sentence_token_position"), (F.col("k") + 1).cast("long").alias("paragraph_token_position"), F.lower("x.t").alias("normalized_form"), F.col("x.t").alias("surface"),
    )


def custom_tokens(sentences: DataFrame, tokenize) -> DataFrame:
    """Tokens by a Python function ``text -> [(surface, form), ...]`` (a morphological analyser, say), in Arrow batches."""
    pairs = T.ArrayType(T.StructType([T.StructField("surface", T.StringType()), T.StructField("form", T.StringType())]))

    @F.pandas_udf(pairs)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"surface": a, "form": b} for a, b in tokenize(t or "")])

    return sentences.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", F.posexplode(found("sentence_text")).alias("n", "t")).select(
        "paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", (F.col("n") + 1).cast("long").alias("token_no"), F.col("t.form").alias("normalized_form"), F.col("t.surface").alias("surface")
    )


def morphemes(sentences: DataFrame, analyse) -> DataFrame:
    """Tokens by a morphological analyser, a Python function ``text -> [(surface, form, parts of speech, unknown), ...]``.

    Up to four parts of speech become ``pos1`` to ``pos4``, missing ones are empty; ``is_oov`` is 1 or 0, or null
    where the analyser says nothing about unknown words (None).
    """
    kind = T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("surface", "form", "pos1", "pos2", "pos3", "pos4")), T.StructField("is_oov", T.LongType())]))

    def one(surface, form, pos, unknown) -> dict:
        pos = [*map(str, pos[:4]), "", "", "", ""][:4]
        return {"surface": surface, "form": form, **{f"pos{i}": p for i, p in enumerate(pos, 1)}, "is_oov": None if unknown is None else int(unknown)}

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [one(*m) for m in analyse(t or "")])

    rows = sentences.select("paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", F.posexplode(found("sentence_text")).alias("n", "t"))
    return rows.select(
        "paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", (F.col("n") + 1).cast("long").alias("token_no"), F.col("t.form").alias("normalized_form"), F.col("t.surface").alias("surface"),
        "t.pos1", "t.pos2", "t.pos3", "t.pos4", "t.is_oov",
    )


#: Names of the rules that split sentences and paragraphs.
SENTENCE_RULES = {True: "v1_split_inside_parentheses", False: "v2_ignore_inner_parentheses_punct"}
PARAGRAPH_RULES = {True: "v3_rule_line_table_detection", False: "v1_default"}


def build_summary(documents: DataFrame, paragraphs: DataFrame, sentences: DataFrame, tokens: DataFrame, tables: bool = False, inside_brackets: bool = False) -> dict[str, int | str]:
    """Counters of a build and the rules it went by."""
    rules = F.col("is_table_paragraph") == 1
    table_lines = F.size(F.filter(F.transform(F.split("paragraph_text", "\n"), uni_trim), lambda v: v != ""))
    p = paragraphs.agg(F.count(F.lit(1)).alias("n"), F.count_if(rules).alias("t"), F.sum("table_parse_error").alias("e"), F.sum("table_trailing_text_detached").alias("d"), F.sum(F.when(rules, table_lines)).alias("lines")).first()
    s = sentences.agg(F.count(F.lit(1)).alias("n"), F.count_if(rules).alias("t")).first()
    d = documents.agg(F.count(F.lit(1)).alias("n"), F.count_if(uni_trim(F.col("raw_text")) == "").alias("e")).first()
    return {
        "source_rows": d.n, "documents_inserted": d.n, "paragraphs_inserted": p.n, "table_paragraphs_inserted": p.t, "table_parse_error_paragraphs": p.e or 0, "table_trailing_text_detached_paragraphs": p.d or 0,
        "table_sentences_inserted": s.t, "table_rule_lines_skipped": (p.lines or 0) - s.t, "sentences_inserted": s.n, "tokens_inserted": tokens.count(), "empty_documents": d.e,
        "sentence_rule_version": SENTENCE_RULES[inside_brackets], "paragraph_rule_version": PARAGRAPH_RULES[tables], "merge_table_lines": int(tables),
    }


def corpus_stats(documents: DataFrame, paragraphs: DataFrame, sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    """Counts of a build as rows (counter, value)."""
    return _counters([
        _document_counts(documents),
        paragraphs.agg(F.count(F.lit(1)).alias("paragraphs"), F.coalesce(F.sum("is_table_paragraph"), F.lit(0)).alias("table_paragraphs"), F.coalesce(F.sum("table_parse_error"), F.lit(0)).alias("table_errors")),
        sentences.agg(F.count(F.lit(1)).alias("sentences")),
        tokens.agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("normalized_form").alias("forms")),
    ])


def plain_corpus_stats(documents: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """``corpus_stats`` of plain documents (ends inside brackets count, no tables), from their texts: each is split once for
    all counters. The first token's row stands for its sentence and, in the first sentence, for the paragraph; a sentence
    without tokens has one row without a form."""
    paragraphs = documents.select(F.explode(paragraph_blocks(F.col("raw_text"))).alias("p"))
    sentences = paragraphs.select(F.posexplode(sentence_texts(F.col("p"))).alias("s", "t"))
    rows = sentences.select("s", F.posexplode_outer(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("n", "surface"))
    first = F.coalesce("n", F.lit(0)) == 0
    forms = rows.groupBy(F.lower("surface").alias("form")).agg(F.count("surface").alias("tokens"), F.count_if(first).alias("sentences"), F.count_if(first & (F.col("s") == 0)).alias("paragraphs"))
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("paragraphs", "sentences", "tokens")}
    found = forms.agg(*(v.alias(c) for c, v in sums.items()), F.count("form").alias("forms"), F.lit(0).alias("table_paragraphs"), F.lit(0).alias("table_errors"))
    return _counters([_document_counts(documents), found])


def _document_counts(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum((F.col("raw_text") == "").cast("long")), F.lit(0)).alias("empty_documents"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("characters"))


def _counters(parts: list[DataFrame]) -> DataFrame:
    """Columns of single rows as rows (counter, value)."""
    return reduce(DataFrame.unionAll, [p.select(F.explode(F.create_map(*(x for c in p.columns for x in (F.lit(c), F.col(c).cast("long"))))).alias("counter", "value")) for p in parts])
