"""The lattice of a long stretch, and tokens as columns."""

import time

from tessera.operators.lattice import Entry, Lattice, Stretches, dictionary_tokens


def test_a_long_run_costs_its_length():
    made = Lattice([Entry("ab", 100, "ab", ("n",))])
    began = time.time()
    assert "".join(e.surface for e in made.path("ax" * 10_000)) == "ax" * 10_000
    assert time.time() - began < 10  # every place looked through the rest of the run before: 19.6 s for 8,000 characters


def test_columns_are_what_analyse_gives():
    made = Lattice([Entry("ab", 100, "AB", ("n", "x")), Entry("a", 100, "a", ())])
    texts = ["ab1 x-a", None, "", "  ", "ab1 ab"]
    rows, numbers, columns, unknown = Stretches(made).tokens(texts)
    found = list(zip(rows.to_pylist(), numbers.to_pylist(), *(c.to_pylist() for c in columns), unknown.to_pylist()))
    want = [(i, k, form, surface, *(*pos, "", "", "", "")[:4], int(new)) for i, t in enumerate(texts) for k, (surface, form, pos, new) in enumerate(made.analyse(t or ""), 1)]
    assert found == want
    assert Stretches(made).tokens([None])[0].to_pylist() == []


def test_sentences_without_tokens_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 11, 1, 0, "ab q"), (1, 12, 2, 0, None), (1, 13, 3, 0, " ")], "paragraph_id long, sentence_id long, sentence_no_in_paragraph long, is_table_paragraph long, sentence_text string")
    entries = spark.createDataFrame([("ab", 1)], "surface string, cost int")
    assert [(r.sentence_id, r.token_no, r.surface, r.is_oov) for r in dictionary_tokens(rows, entries).orderBy("token_no").collect()] == [(11, 1, "ab", 0), (11, 2, "q", 1)]
    assert dictionary_tokens(rows.limit(0), entries).count() == 0


def test_ends_of_stretches_are_kept_for_others(monkeypatch):
    entries = [Entry("ab", 100, "ab", ("n",)), Entry("a", 100, "a", ("v",)), Entry("abc", 90, "abc", ("n", "x")), Entry("bc", 100, "bc", ())]
    connections = {("n", "n"): 500, ("", "n"): -50, ("v", "unknown"): -30_000}
    texts = ["xabc", "abc", "ababc", "cabab", "ab1abc-a", "zababc" * 9]
    alone = [Lattice(entries, connections).path(t) for t in texts]
    made, asked = Lattice(entries, connections), []
    found = made._found
    monkeypatch.setattr(made, "_found", lambda text, i, *more: asked.append(text[i:]) or found(text, i, *more))
    assert [made.path(t) for t in texts] == alone
    short = [x for x in asked if len(x) <= 24]
    assert len(short) == len(set(short))  # every stretch was looked through anew before
    assert [made.path(t) for t in reversed(texts)] == alone[::-1]
