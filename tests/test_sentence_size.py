"""Sentences by the quick expression and the full one, tables some texts at a time, sentences without a listed form."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import ingest


def test_narrow_sentences_are_the_same(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab .!?\"')］」) é" + ("。．！？" if i % 2 else "")) for _ in range(rng.randrange(1, 40))).strip(),) for i in range(600)]
    rows = [r for r in rows if r[0]]
    df = spark.createDataFrame(rows, "p string")
    for r in df.select("p", ingest.sentence_texts(F.col("p")).alias("got")).collect():
        want = [t for t in (x.strip() for x in re.findall(ingest.SENTENCE, r.p)) if t]
        assert r.got == (want or [r.p])
    # a text of 8 MB without a wide end takes the quick expression: no class with wide characters sees it
    assert not any(c in ingest.NARROW_SENTENCE.split("[" + re.escape(ingest.CLOSERS) + "]")[0] for c in ingest.WIDE_ENDS)


def test_table_texts_are_objects_some_at_a_time():
    table = "A line.\n\n| a | b |\n|--|--|\n| 1 | 2 | rest"
    texts = [table if k % 3 else None for k in range(2 * ingest.TEXTS + 5)]
    for some in (texts, []):
        got = ingest.table_paragraph_blocks.func(pa.array(some, pa.string())).to_pylist()
        assert [[tuple(b.values()) for b in x] for x in got] == [list(ingest.table_blocks(t)) if t else [] for t in some]


def test_sentences_without_a_form_are_left_out_alone(spark):
    rows = [(1, 10, 1, 0, t, 0) for t in ("The cat.", "no such", "OTHER the", "KKelvin K", "ΣΣ İx", "")]
    df = spark.createDataFrame(rows, "paragraph_id long, sentence_id long, sentence_no_in_paragraph long, is_table_paragraph long, sentence_text string, tokens_before long")
    everything = ingest.tokens_of_sentences(df).collect()
    for forms in (["the"], ["the", "k"], ["σς", "cat"], []):
        got = ingest.tokens_of_sentences(df, forms)
        assert sorted(got.collect()) == sorted(r for r in everything if r.normalized_form in forms)
