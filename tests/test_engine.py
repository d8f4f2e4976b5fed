"""Operators on small hand-built corpora."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import facet_values, first_line, html_escape, numeric_order, tag_escape, uni_trim
from tessera.operators import evaluate, hits, ingest, output, positions, render, select
from tessera.plans.config import compile_runtime
from tessera.session import Session
from tessera.sources import readers
from tessera.streaming.matching import match_paragraphs

SENTENCE = "sentence_id long, paragraph_id long, sentence_no_in_paragraph long, is_table_paragraph long, sentence_text string"
TOKEN = "paragraph_id long, sentence_id long, token_no long, normalized_form string, surface string"


def corpus(spark, units):
    """units: {paragraph: {sentence: [forms]}}; token numbers from 0."""
    sentences = [(s, p, n, 0, "".join(forms)) for p, ss in units.items() for n, (s, forms) in enumerate(ss.items(), 1)]
    tokens = [(p, s, i, f, f) for p, ss in units.items() for s, forms in ss.items() for i, f in enumerate(forms)]
    return spark.createDataFrame(tokens, TOKEN), spark.createDataFrame(sentences, SENTENCE)


def rules(*entries, **settings):
    got = compile_runtime({**settings, "cooccurrence_conditions": [{"categories": ["c"], **e} for e in entries]})
    assert not [i for i in got.issues if i.severity == "error"], got.issues
    return got


def matched(spark, units, *entries, annotations=None, **settings):
    tokens, sentences = corpus(spark, units)
    pairs = spark.createDataFrame(annotations, "paragraph_id long, annotation_pair string") if annotations else None
    e = evaluate.Evaluation(rules(*entries, **settings), tokens, sentences, pairs).build()
    return {r.paragraph_id: r.matched_condition_ids_text for r in select.select_paragraphs(e).collect()}


TWO = {1: {11: ["a", "b", "c", "d"]}, 2: {21: ["c", "d"]}}


def test_basic_selection(spark):
    assert matched(spark, TWO, {"condition_id": "x", "forms": ["a", "b"]}) == {1: "x"}


def test_window_is_symmetric_and_excludes(spark):
    units = {1: {10: ["a", "b", "c"]}, 2: {20: ["b", "a"]}, 3: {30: ["a", "z", "z", "b"]}}
    group = {"forms": ["a", "b"], "anchor_form": "a", "max_token_distance": 1}
    assert matched(spark, units, {"condition_id": "x", "form_groups": [group]}) == {1: "x", 2: "x"}
    assert matched(spark, units, {"condition_id": "x", "form_groups": [group | {"max_token_distance": 3, "exclude_forms_any": ["z", "c"]}]}) == {2: "x"}


def test_distance_over_sentences_uses_paragraph_positions(spark):
    units = {1: {11: ["a", "x", "x"], 12: ["b"]}}
    assert matched(spark, units, {"condition_id": "x", "forms": ["a", "b"], "max_token_distance": 3}) == {1: "x"}
    assert matched(spark, units, {"condition_id": "x", "forms": ["a", "b"], "max_token_distance": 2}) == {}
    assert matched(spark, units, {"condition_id": "x", "forms": ["a", "b"], "max_token_distance": 9, "search_scope": "sentence"}) == {}


def test_groups_combine_and_promote(spark):
    units = {1: {11: ["a", "b"], 12: ["q"]}, 2: {21: ["a"], 22: ["b", "q"]}, 3: {31: ["a", "b"]}}
    mixed = {"condition_id": "x", "form_groups": [{"forms": ["a", "b"], "search_scope": "sentence"}, {"forms": ["q"], "combine_logic": "and", "search_scope": "paragraph"}]}
    assert matched(spark, units, mixed) == {1: "x"}
    negative = {"condition_id": "x", "form_groups": [{"forms": ["a"]}, {"forms": ["q"], "match_logic": "not", "combine_logic": "and"}]}
    assert matched(spark, units, negative) == {3: "x"}


def test_references_follow_their_order(spark):
    chain = [{"condition_id": "z", "required_condition_ids_all": ["y"]}, {"condition_id": "y", "required_categories_any": ["k"], "forms": ["c"]}, {"condition_id": "k1", "categories": ["k"], "forms": ["a"]}]
    # y comes before k1 in the order of evaluation, so its category is not there yet
    assert matched(spark, TWO, *chain) == {1: "k1"}
    assert matched(spark, TWO, chain[2], chain[0], chain[1]) == {1: "k1, y, z"}
    assert matched(spark, TWO, {"condition_id": "e", "excluded_condition_ids_any": ["nobody"]}) == {1: "e", 2: "e"}
    assert matched(spark, TWO, {"condition_id": "e", "required_condition_ids_all": ["nobody"]}) == {}


def test_all_logic_cap_and_annotations(spark):
    a, b = {"condition_id": "a", "forms": ["a"]}, {"condition_id": "b", "forms": ["c"]}
    assert matched(spark, TWO, a, b, condition_match_logic="all") == {1: "a, b"}
    assert matched(spark, TWO, b, max_reconstructed_paragraphs=1) == {1: "b"}
    note = {"condition_id": "n", "annotation_filters": [{"namespace": "s", "key": "k", "value": "v"}]}
    assert matched(spark, TWO, note, annotations=[(2, "s:k=v"), (1, "s:k=w")]) == {2: "n"}
    assert matched(spark, TWO, note | {"forms": ["a"]}, annotations=[(2, "s:k=v")]) == {}


def test_text_rules_are_literal(spark):
    assert matched(spark, TWO, {"condition_id": "t", "text_groups": [{"texts": ["ab", "d"]}, {"texts": ["x.y"], "match_logic": "not", "combine_logic": "and"}]}) == {1: "t"}


def group_lines(spark, units, *entries, **settings):
    tokens, sentences = corpus(spark, units)
    found = hits.locate(positions.positioned(tokens, sentences), rules(*entries, **settings))
    lines = {}
    for r in found.rows.orderBy("match_group_id", "paragraph_token_position").collect():
        lines.setdefault(r.match_group_id, []).append(r.token_no)
    return lines, found


ABAB = {1: {11: ["a", "b", "a", "b"]}}
PAIR = {"condition_id": "p", "forms": ["a", "b"], "max_token_distance": 3}


def test_strict_and_greedy_groups(spark):
    assert group_lines(spark, ABAB, PAIR)[0] == {"p:1:1": [0, 1], "p:1:2": [1, 2], "p:1:3": [2, 3], "p:1:4": [0, 3]}
    assert group_lines(spark, ABAB, PAIR, distance_matching_mode="approx")[0] == {"p:1:1": [0, 1], "p:1:2": [2, 3]}
    lines, found = group_lines(spark, ABAB, PAIR, distance_match_combination_cap=3)
    assert len(lines) == 2 and [(r.unit_id, r.combination_count) for r in found.warnings.collect()] == [(1, 4)]


def test_strict_mode_has_a_limit(spark):
    with pytest.raises(Exception, match="distance_match_strict_limit_exceeded"):
        group_lines(spark, ABAB, PAIR, distance_matching_mode="strict", distance_match_strict_safety_limit=3)


def test_simple_and_group_hits(spark):
    assert group_lines(spark, {1: {11: ["a", "x", "b", "a"]}}, {"condition_id": "s", "forms": ["a", "b"]})[0] == {"s:1:token:1": [0], "s:1:token:2": [2], "s:1:token:3": [3]}
    window = {"condition_id": "w", "form_groups": [{"forms": ["a", "b"], "anchor_form": "a", "max_token_distance": 1}, {"forms": ["c"], "combine_logic": "or", "match_logic": "or"}]}
    assert group_lines(spark, {1: {11: ["c", "a", "x", "a", "b"]}}, window)[0] == {"w:g2:paragraph:1": [0]}
    assert group_lines(spark, {1: {11: ["a", "b", "c"]}}, window)[0] == {"w:g1:paragraph:1": [0, 1]}
    negative = {"condition_id": "n", "form_groups": [{"forms": ["a"]}, {"forms": ["z"], "match_logic": "not", "combine_logic": "and"}]}
    assert group_lines(spark, {1: {11: ["a", "b"]}, 2: {21: ["a", "z"]}}, negative)[0] == {"n:g1:paragraph:1": [0]}


def test_sentence_mode(spark):
    units = {1: {11: ["a", "b"], 12: ["q"]}, 2: {21: ["a", "b"]}}
    tokens, sentences = corpus(spark, units)
    extra = spark.createDataFrame([(13, 1, 3, 0, "no tokens")], SENTENCE)
    r = rules({"condition_id": "base", "form_groups": [{"forms": ["a", "b"], "search_scope": "sentence"}], "overall_search_scope": "sentence"}, {"condition_id": "k", "forms": ["q"], "search_scope": "sentence"}, {"condition_id": "y", "form_groups": [{"forms": ["a", "q"]}], "required_condition_ids_all": ["k"]}, analysis_unit="sentence")
    e = evaluate.Evaluation(r, tokens, sentences.unionByName(extra)).build()
    got = {x.sentence_id: x.matched_condition_ids_text for x in select.SentenceSelection(e, tokens).sentences().collect()}
    assert got == {11: "base", 12: "k, y", 21: "base"}


def test_rendering_round_trip(spark):
    tokens, sentences = corpus(spark, {1: {11: ["<a>", "b"]}})
    r = rules({"condition_id": 'q"1', "categories": ["x", "y"], "forms": ["<a>"]})
    placed = positions.positioned(tokens, sentences)
    row = render.rendered_paragraphs(placed, render.token_annotations(hits.locate(placed, r).rows)).withColumn("s", render.parse_tagged("paragraph_text_tagged")).first()
    assert row.paragraph_text == "<a>b" and row.paragraph_text_html.startswith('<mark class="co-hit" data-condition-ids="q&quot;1" data-categories="x | y" title="x, y / q&quot;1">&lt;a&gt;</mark>b')
    assert [(s.text, s.is_hit) for s in row.s] == [("<a>", True), ("b", False)] and row.s[0].attributes["condition_ids"] == 'q"1'


def test_ingest(spark):
    def blocks(text):
        return spark.createDataFrame([(text,)], "t string").select(ingest.paragraph_blocks(F.col("t"))).first()[0]

    assert blocks(" a \r\n b ") == ["a", "b"] and blocks("a\nb\n \n\nc") == ["a\nb", "c"] and blocks("") == [] and blocks("　x　") == ["x"]
    assert ingest.bracketed_sentences("a（b。c）d。」e。") == ["a（b。c）d。」", "e。"]
    assert ingest.bracketed_sentences("x. (y. z) w.") == ["x.", "(y. z) w."] and ingest.bracketed_sentences("（a。b。") == ["（a。b。"]
    table = list(ingest.table_blocks("intro\n| h | k |\n|---|:--:|\n| 1 | 2 | tail\nend"))
    assert table == [("intro", 0, None, 0, 0), ("| h | k |\n|---|:--:|\n| 1 | 2 |", 1, 2, 0, 1), ("tail", 0, None, 0, 0), ("end", 0, None, 0, 0)]
    assert ingest.cells(r"| a \| b | c |") == [r"a \| b", "c"] and not ingest.is_rule("| - |")
    docs = spark.createDataFrame([(1, "A b. C!", "s", "l"), (2, None, None, "l")], "doc_id long, text string, source string, lang string")
    frame = ingest.documents_frame(docs)
    sentences = ingest.sentences_frame(ingest.paragraphs_frame(frame))
    assert [r.sentence_text for r in sentences.orderBy("sentence_id").collect()] == ["A b.", "C!"]
    assert frame.where("document_id = 2").first().line_count == 0
    assert [r.surface for r in ingest.custom_tokens(sentences, lambda t: [(x, x.lower()) for x in t.split()]).orderBy("sentence_id", "token_no").collect()] == ["A", "b.", "C!"]


def test_scalar_functions(spark):
    row = spark.createDataFrame([("A, B、A;", "<'\">&", 'a"\\', "\n x \ny", "　z ")], "a string, b string, c string, d string, e string").select(facet_values(F.col("a")).alias("a"), html_escape(F.col("b")).alias("b"), tag_escape(F.col("c")).alias("c"), first_line(F.col("d")).alias("d"), uni_trim(F.col("e")).alias("e")).first()
    assert list(row) == [["A", "B"], "&lt;&#x27;&quot;&gt;&amp;", 'a\\"\\\\', "x", "z"]
    values = spark.createDataFrame([("10",), ("b",), ("",), ("2",), ("a",)], "v string")
    assert [r.v for r in values.orderBy(*numeric_order(F.col("v"))).collect()] == ["", "2", "10", "a", "b"]


def test_facets_and_context(spark):
    records = spark.createDataFrame([("g1, g2", "x"), ("g2", ""), ("", "x")], "match_group_ids_text string, category1 string")
    counts = {(r.facet, r.value): r["count"] for r in output.facet_counts(records).collect()}
    assert counts == {("match_group_ids_text", "g1"): 1, ("match_group_ids_text", "g2"): 2, ("match_group_ids_text", ""): 1, ("category1", "x"): 2, ("category1", ""): 1}
    assert output.facet_filter(records, {"match_group_ids_text": ["g2"], "category1": ["x"]}).count() == 1
    paragraphs = spark.createDataFrame([(i, 1, i) for i in range(1, 7)], "paragraph_id long, document_id long, paragraph_no long")
    context = output.paragraph_context(paragraphs, paragraphs.where("paragraph_id = 2").select("paragraph_id"))
    assert sorted(r.paragraph_no for r in context.collect()) == [1, 2, 3, 4]
    assert tuple(output.neighbours(context).first())[1:] == (1, 3)


def test_annotations_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    assert readers.annotations(spark, str(path))[0].count() == 0
    for value in ("v", "v", "w"):
        readers.append_annotation(str(path), {"target_type": "paragraph", "target_id": " 7 ", "label_namespace": "n", "label_key": "k", "label_value": value})
    readers.append_annotation(str(path), {"target_type": "document", "target_id": "x", "label_namespace": "n", "label_key": "k", "label_value": "v"})
    rows, issues = readers.annotations(spark, str(path))
    assert issues == [] and rows.count() == 3
    assert {(r.code, r.n) for r in output.annotation_issues(rows).collect()} == {("annotation_duplicate_deduplicated", 2), ("annotation_value_conflict", 2)}
    assert output.annotation_summary(rows).first().manual_annotation_pairs_text == "n:k=v\nn:k=w"
    readers.append_annotation(str(path), {"target_type": "page", "target_id": "1"})
    assert [i.code for i in readers.annotations(spark, str(path))[1]] == ["annotation_target_type_unknown"]
    (tmp_path / "b.csv").write_text("target_type,target_id\nparagraph,1\n")
    assert {i.field_name for i in readers.annotations(spark, str(tmp_path / "b.csv"))[1]} == {"label_namespace", "label_key", "label_value"}


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "12_city_law.txt").write_bytes("﻿a".encode())
    (tmp_path / "sub" / "x_y.md").write_text("b")
    (tmp_path / "bad.txt").write_text("c")
    rows, issues = readers.text_folder(spark, str(tmp_path))
    assert [(r.category1, r.category2, r.raw_text) for r in rows.collect()] == [("city", "law", "a"), ("x", "y", "b")]
    assert [i.code for i in issues] == ["invalid_file_name"]
    assert readers.text_folder(spark, str(tmp_path / "no"))[1][0].code == "input_dir_not_found"
    assert readers.text_folder(spark, str(tmp_path / "sub"), (str(tmp_path),))[1][0].code == "forbidden_input_dir"


def test_text_folder_of_any_file_system(spark, tmp_path):
    (tmp_path / "in" / "a" / "secret").mkdir(parents=True)
    (tmp_path / "in" / "b").mkdir()
    for name, text in (("x_y.txt", "top"), ("a/p_q.md", "kept"), ("a/secret/no_no.txt", "hidden"), ("b/r_s.txt", "beside"), ("b/t_u.bin", "other")):
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "in" / "link").symlink_to(tmp_path / "in" / "a" / "secret")
    (tmp_path / "elsewhere").symlink_to(tmp_path / "in")
    want = [("a/p_q.md", "kept"), ("b/r_s.txt", "beside"), ("x_y.txt", "top")]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", (tmp_path / "in").as_uri())
    (tmp_path / "in" / "a" / "secret").chmod(0)  # whoever lists it fails, unless it is root
    try:
        for folder, hidden in ((str(tmp_path / "in"), str(tmp_path / "in" / "a" / "secret")), ((tmp_path / "elsewhere").as_uri(), (tmp_path / "in" / "link").as_uri()), ("viewfs://shelf/in", "viewfs://shelf/in/a/secret")):
            rows, issues = readers.text_folder(spark, folder, (hidden, *(["viewfs://shelf/in/link"] if folder.startswith("viewfs") else [])))
            assert issues == [] and sorted((r.relative_path, r.raw_text) for r in rows.collect()) == want
    finally:
        (tmp_path / "in" / "a" / "secret").chmod(0o755)
    assert readers.text_folder(spark, "viewfs://shelf/in/a", ("viewfs://shelf/in",))[1][0].code == "forbidden_input_dir"
    assert readers.text_folder(spark, "viewfs://shelf/in/none")[1][0].code == "input_dir_not_found"
    assert readers.text_folder(spark, "viewfs://shelf/in/x_y.txt")[1][0].code == "input_dir_not_directory"
    assert readers.text_folder(spark, str(tmp_path / "in" / "a"), (str(tmp_path / "in" / "a" / "secret"),))[0].count() == 1


def test_latest_text_of_each_stem(spark):
    import datetime
    import random
    import re

    rng = random.Random(5)
    paths = [f"/{rng.choice('mn')}/{rng.choice(['a', 'b-c', 'b'])}-{y}-{m:02}-{d:02}_10-00-{s:02}.{e}" for y in (2024, 2025) for m in (1, 2, 13) for d in (1, 30) for s in (0, 59, 60) for e in ("md", "MD", "txt")]
    paths += ["/m/a.md", "/m/-2025-01-01_00-00-00.md", "/m/z-2025-1-1_00-00-00.md", "/n/t-2025-01-01_00-00-00.md", "/m/t-2025-01-01_00-00-00.md"]
    best = {}
    for p in sorted(set(paths), key=lambda p: (p.rpartition("/")[2], p)):
        m = re.fullmatch(r"(.+)-(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.[mM][dD]", p.rpartition("/")[2])
        try:
            at = m and datetime.datetime.strptime(m[2], "%Y-%m-%d_%H-%M-%S")
        except ValueError:
            continue
        if m and (m[1] not in best or at > best[m[1]][0]):
            best[m[1]] = (at, p)
    got = {r.stem: r.path for r in readers.latest_texts(spark.createDataFrame([(p,) for p in paths], "source_file_path string")).collect()}
    assert got == {k: p for k, (_, p) in best.items()} and got["t"] == "/m/t-2025-01-01_00-00-00.md"


def test_cheapest_path_against_all_segmentations(spark):
    import random

    from tessera.operators.lattice import START, Entry, Lattice, dictionary_tokens

    rng = random.Random(13)
    for _ in range(150):
        entries = [Entry("".join(rng.choice("abと1") for _ in range(rng.randint(1, 4))), rng.choice([100, 200, 30_000]), "f", (rng.choice("xyz"),)) for _ in range(rng.randint(0, 9))]
        costs = {(a, b): rng.choice([0, 50, 100]) for a in ("x", "y", "unknown", START) for b in ("x", "z", "unknown")}
        made, text = Lattice(entries, costs), "".join(rng.choice("abと1?") for _ in range(rng.randint(1, 7)))

        def paths(i, left):
            if i == len(text):
                yield 0, []
                return
            for e in made.candidates(text, i):
                for cost, rest in paths(i + len(e.surface), e.pos[0]):
                    yield costs.get((left, e.pos[0]), 0) + e.cost + cost, [e, *rest]

        best = min(paths(0, START), key=lambda c: (c[0], len(c[1]), [(-len(e.surface), e.pos, e.form) for e in c[1]]))
        assert [(e.surface, e.pos) for e in made.path(text)] == [(e.surface, e.pos) for e in best[1]], (text, entries)
    words = [("東京都", 100, None, ["noun", "name"], ["東京", "都"], None), ("東京", 300, None, ["noun"], None, None), ("に", 10, "に", ["particle"], None, None), ("行く", 200, "行く", None, None, None), ("x y", 1, None, None, None, None), (None, 1, None, None, None, None)]
    table = spark.createDataFrame(words, "surface string, cost int, form string, pos array<string>, parts_a array<string>, parts_b array<string>")
    sentences = spark.createDataFrame([(1, 1, 1, 0, "東京都に 行くABC12"), (2, 1, 2, 0, None), (3, 1, 3, 0, " ")], SENTENCE)
    got = {m: [(r.surface, r.pos1, r.is_oov) for r in dictionary_tokens(sentences, table, mode=m).orderBy("sentence_id", "token_no").collect()] for m in "AC"}
    tail = [("に", "particle", 0), ("行く", "", 0), ("ABC", "unknown", 1), ("12", "unknown", 1)]
    assert got == {"C": [("東京都", "noun", 0), *tail], "A": [("東京", "noun", 0), ("都", "unknown", 1), *tail]}
    with pytest.raises(ValueError):
        dictionary_tokens(sentences, table, mode="D")


def test_a_view_has_one_unit(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "paragraph_id long, sentence_id long, t string")
    assert output.write_view(rows, str(tmp_path / "v.csv")) == 2 and (tmp_path / "v.csv").read_bytes() == b"\xef\xbb\xbfparagraph_id,t\r\n1,a\r\n2,b\r\n"
    assert output.write_view(rows.withColumn("sentence_id", F.col("paragraph_id")), str(tmp_path / "v.csv")) == 2
    for bad in (rows.limit(0), rows.union(spark.createDataFrame([(3, 31, "c")], rows.schema))):
        with pytest.raises(ValueError):
            output.write_view(bad, str(tmp_path / "w.csv"))
    assert not (tmp_path / "w.csv").exists()


@pytest.fixture()
def database(tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE analysis_tokens (paragraph_id INTEGER, sentence_id INTEGER, token_no INTEGER, normalized_form TEXT, surface TEXT)")
        db.execute("CREATE TABLE analysis_sentences (sentence_id INTEGER, paragraph_id INTEGER, sentence_no_in_paragraph INTEGER)")
        db.execute("CREATE TABLE analysis_paragraphs (paragraph_id INTEGER, document_id INTEGER)")
        db.execute("CREATE TABLE analysis_documents (document_id INTEGER, category1 TEXT, category2 TEXT)")
        db.executemany("INSERT INTO analysis_tokens VALUES (?,?,?,?,?)", [(1, 11, i, f, f) for i, f in enumerate("abcd")] + [(2, 21, i, f, f) for i, f in enumerate("cd")])
        db.executemany("INSERT INTO analysis_sentences VALUES (?,?,?)", [(11, 1, 1), (21, 2, 1)])
        db.executemany("INSERT INTO analysis_paragraphs VALUES (?,?)", [(1, 100), (2, 100)])
        db.execute("INSERT INTO analysis_documents VALUES (100, 'city', 'law')")
    return path


def test_session_from_sqlite_to_csv_and_back(spark, database, tmp_path):
    session = Session.from_sqlite(spark, database, partitions=2)
    r = rules({"condition_id": "x", "forms": ["a", "b"]})
    assert session.export_csv(r, str(tmp_path / "out.csv"), str(tmp_path / "meta.json"), "job") == 1
    rows, unit = readers.results(spark, str(tmp_path / "out.csv"))
    row = rows.first()
    assert unit == "paragraph" and (row.category1, row.paragraph_text, row.matched_condition_ids_text, row.match_group_count, row.matched_form_group_logics_text) == ("city", "abcd", "x", "2", "x:g1=and")
    sentences = session.analyze(rules({"condition_id": "x", "forms": ["c"], "search_scope": "sentence"}, analysis_unit="sentence")).export
    assert sorted(x.sentence_id for x in sentences.collect()) == [11, 21] and len(sentences.columns) == 20
    assert session.analyze(r) is session.analyze(r)
    output.write_csv(rows, str(tmp_path / "view.csv"), bom=True, crlf=True)
    assert (tmp_path / "view.csv").read_bytes().startswith(b"\xef\xbb\xbf") and b"\r\n" in (tmp_path / "view.csv").read_bytes()
    assert readers.results(spark, str(tmp_path / "view.csv"))[0].count() == 1
    with pytest.raises(RuntimeError):
        readers.required(readers.guarded(lambda: readers.read_sqlite(spark, database, "none"), "none", database))


def test_stream_matches_as_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the law of a\nnothing", "s", "l"), (2, "of the law", "s", "l")], "doc_id long, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "in"))
    r = rules({"condition_id": "x", "form_groups": [{"forms": ["the", "of"]}], "text_groups": [{"texts": ["law of"]}]})
    stream = ingest.documents_frame(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = match_paragraphs(stream, r).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [x.document_id for x in spark.table("found").collect()] == [1]
    assert match_paragraphs(ingest.documents_frame(docs), r).count() == 1
    with pytest.raises(ValueError):
        match_paragraphs(stream, rules({"condition_id": "x", "forms": ["a"], "max_token_distance": 1}))


def test_store_appends_cost_the_run_only(spark, tmp_path):
    from tessera.sources.store import Conflict, Store

    def files(run):
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "c" / "runs" / run).rglob("*") if p.is_file()}

    store = Store(spark, (tmp_path / "c").as_uri())
    assert not store.exists() and store.runs() == []
    docs = spark.createDataFrame([("a", "b", "One two. Three."), ("a", "b", "Four.")], "category1 string, category2 string, raw_text string")
    first, _ = store.build(docs)
    before = files(first)
    second, _ = store.build(docs)
    assert files(first) == before and store.runs() == [first, second] and sorted(r.document_id for r in store.table("documents").collect()) == [1, 2, 3, 4]
    # a build that fails leaves folder and manifest as they were
    manifests = sorted(p.name for p in (tmp_path / "c" / "manifests").glob("[0-9]*"))
    assert store.build(docs.drop("category1"))[0] is None and sorted(p.name for p in (tmp_path / "c" / "manifests").glob("[0-9]*")) == manifests
    assert sorted(p.name for p in (tmp_path / "c" / "runs").iterdir()) == sorted([first, second])
    # a commit that another build has overtaken starts from the newer manifest
    other, calls = Store(spark, (tmp_path / "c").as_uri()), []

    def overtaken(runs):
        if not calls:
            calls.append(other._commit(lambda r: [*r, {"id": "other", "last_document": 9}]))
        return [*runs, {"id": "mine", "last_document": 9}]

    assert [r["id"] for r in store._commit(overtaken)] == [first, second, "other", "mine"]
    store._commit(lambda runs: [r for r in runs if r["id"] in (first, second)])

    def always(runs):
        other._commit(lambda r: r)
        return runs

    with pytest.raises(Conflict):
        store._commit(always)
    store.purge(first)
    assert store.runs() == [second] and not files(first) and store.table("tokens").where(F.col("run_id") == first).count() == 0
    (tmp_path / "c" / "runs" / "orphan").mkdir()
    assert store.vacuum() == ["orphan"] and store.vacuum() == [] and len(list((tmp_path / "c" / "manifests").glob("[0-9]*.json"))) <= 2
    store.purge(second)
    with pytest.raises(FileNotFoundError):
        store.table("documents")


def test_store_appends_swaps_and_purges(spark, tmp_path):
    from tessera.sources.store import Store

    store = Store(spark, str(tmp_path / "corpus"))
    docs = spark.createDataFrame([("city", "law", "One. Two.\n\nThree"), ("town", "law", "")], "category1 string, category2 string, raw_text string")
    first, issues = store.build(docs, "here", report=str(tmp_path / "report.json"))
    assert issues == [] and store.table("sentences").count() == 3 and store.table("runs").first().status == "succeeded"
    second, _ = store.build(docs.limit(1))
    assert sorted(r.document_id for r in store.table("documents").collect()) == [1, 2, 3] and store.table("runs").count() == 2
    store.purge(first)
    assert [r.run_id for r in store.table("runs").collect()] == [second] and store.table("tokens").where(F.col("run_id") == first).count() == 0
    run, issues = store.build(docs.drop("raw_text"), report=str(tmp_path / "report.json"))
    assert run is None and issues[0].code == "build_failed" and "failed" in (tmp_path / "report.json").read_text() and store.table("runs").count() == 1
    assert store.build(docs, fresh=True)[1] == [] and store.table("runs").count() == 1
    session = Session(store.table("tokens"), store.table("sentences"), store.table("paragraphs"), store.table("documents"))
    assert session.analyze(rules({"condition_id": "x", "forms": ["one"]})).export.first().category1 == "city"


def test_rules_have_facets(spark):
    records = output.rule_records(spark, rules({"condition_id": "a", "categories": ["x", "y"], "forms": ["p"], "max_token_distance": 2}, {"condition_id": "b", "text_groups": [{"texts": ["t"], "search_scope": "sentence"}]}))
    counts = {(r.facet, r.value): r["count"] for r in output.facet_counts(records, output.RULE_FACETS).collect()}
    assert counts["categories", "x"] == 1 and counts["has_distance", "yes"] == 1 and counts["scope", "sentence"] == 1
    assert output.facet_filter(records, {"has_text": ["yes"]}, output.RULE_FACETS).first().condition_id == "b"


def test_greedy_against_trying_all():
    """The narrowest of all combinations of free tokens, again and again."""
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        k, n, d = rng.choice([2, 3]), rng.randrange(1, 14), rng.randrange(0, 12)
        places = sorted(rng.sample(range(40), n))
        forms = [rng.randrange(k) for _ in places]
        free, want, number = set(range(n)), [], 0
        while True:
            options = [c for c in itertools.product(*([i for i in free if forms[i] == f] for f in range(k)))]
            ranges = [(max(places[i] for i in c) - min(places[i] for i in c), min(places[i] for i in c), max(places[i] for i in c), [places[i] for i in c], c) for c in options]
            if not ranges or min(ranges)[0] > d:
                break
            number += 1
            for i in min(ranges)[4]:
                want.append((i, number))
                free.remove(i)
        assert hits.greedy(places, forms, k, d) == want


def test_numbers_that_reach_the_step_are_an_error(spark):
    docs = ingest.documents_frame(spark.createDataFrame([(1, "\n".join(["x"] * ingest.PARAGRAPH_STEP))], "doc_id long, text string").selectExpr("*", "'' source", "'' lang"))
    with pytest.raises(Exception, match="paragraphs: at most"):
        ingest.paragraphs_frame(docs).agg(F.max("paragraph_id")).collect()


def test_positions_by_either_way(spark):
    rows = [(1, "One two. Three (four. five) six!\nNext line here. And more"), (2, ""), (3, "x")]
    docs = ingest.documents_frame(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'' source", "'' lang"))
    paragraphs = ingest.paragraphs_frame(docs)
    sentences = ingest.sentences_frame(paragraphs)
    plain = ingest.tokens_frame(sentences)
    a = positions.positioned(plain, sentences)
    b = ingest.positioned_tokens(paragraphs)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    only = positions.positioned(plain, sentences, ["six", "more"]).select("normalized_form", "paragraph_token_position").collect()
    assert sorted(map(tuple, only)) == [("more", 5), ("six", 6)]
    numbers = ingest.with_document_numbers(sentences)
    assert sorted(map(str, numbers.collect())) == sorted(map(str, ingest.numbered_sentences(docs).select(numbers.columns).collect()))


def test_one_more_annotation(spark):
    rows = [("1", "2", "a:k=v\nb:k=w", "a, b"), ("2", "", "", ""), ("3", "x", None, None)]
    df = spark.createDataFrame(rows, "paragraph_id string, manual_annotation_count string, manual_annotation_pairs_text string, manual_annotation_namespaces_text string")
    for p, want in ((1, ("3", "a:k=v\nb:k=w\naa:q=1", "a, aa, b")), (2, ("1", "aa:q=1", "aa")), (3, ("1", "aa:q=1", "aa"))):
        got = {r[0]: tuple(r[1:]) for r in output.add_annotation(df, p, " aa", "q ", "1").collect()}
        assert got[str(p)] == want and all(got[r[0]] == r[1:] for r in rows if r[0] != str(p))


def test_facet_list_orders_and_keeps_chosen(spark):
    counts = spark.createDataFrame([("sentence_count", v, 1) for v in ("10", "2", "", "x")] + [("category1", v, 1) for v in ("b2", "b10", "a")], "facet string, value string, count long")
    got = [(r.facet, r.value) for r in output.facet_list(counts).collect()]
    assert got == [("category1", "a"), ("category1", "b10"), ("category1", "b2"), ("sentence_count", ""), ("sentence_count", "2"), ("sentence_count", "10"), ("sentence_count", "x")]
    got = [(r.value, r.is_match, r.is_chosen) for r in output.facet_list(counts, " B", {"category1": ["a", "b2"]}).collect()]
    assert got == [("b10", True, False), ("b2", True, True), ("a", False, True)]


def test_context_by_location(spark):
    df = spark.createDataFrame([(1, n, f"p{n}") for n in range(1, 8)] + [(2, 3, "other")], "document_id long, paragraph_no long, paragraph_text string")
    assert [(r.paragraph_no, r.is_center) for r in output.context_by_location(df, 1, 2, 2).collect()] == [(1, False), (2, True), (3, False), (4, False)]


def test_morphemes_and_summary(spark):
    docs = ingest.documents_frame(spark.createDataFrame([(1, "Top line.\n\n| a | b |\n|---|---|\n| c | d | tail (x. y)."), (2, " ")], "doc_id long, text string").selectExpr("*", "'' source", "'' lang"))
    paragraphs = ingest.paragraphs_frame(docs, tables=True)
    sentences = ingest.sentences_frame(paragraphs, inside_brackets=False)
    tokens = ingest.morphemes(sentences, lambda t: [(w, w.lower(), ("noun", "common"), None if w == "a" else w == "Top") for w in t.split()])
    first = tokens.where("surface = 'Top'").first()
    assert (first.pos1, first.pos2, first.pos3, first.pos4, first.is_oov, first.normalized_form) == ("noun", "common", "", "", 1, "top")
    assert tokens.where("surface = 'a'").first().is_oov is None
    got = ingest.build_summary(docs, paragraphs, sentences, tokens, tables=True)
    assert got == {
        "source_rows": 2, "documents_inserted": 2, "paragraphs_inserted": 3, "table_paragraphs_inserted": 1, "table_parse_error_paragraphs": 0, "table_trailing_text_detached_paragraphs": 1, "table_sentences_inserted": 2,
        "table_rule_lines_skipped": 1, "sentences_inserted": 4, "tokens_inserted": tokens.count(), "empty_documents": 1, "sentence_rule_version": "v2_ignore_inner_parentheses_punct",
        "paragraph_rule_version": "v3_rule_line_table_detection", "merge_table_lines": 1,
    }


def test_condition_documents(tmp_path):
    from tessera.plans import config

    doc = {"analysis_unit": "paragraph", "cooccurrence_conditions": [{"condition_id": "a", "categories": ["x", "x "]}, {"categories": "y"}, 5, {"condition_id": "a"}]}
    whole = config.chosen_conditions(doc)["cooccurrence_conditions"]
    assert [(c["condition_id"], c["categories"]) for c in whole] == [("a", ["x"]), ("condition_2", ["y"]), ("a_2", [config.NO_CATEGORY])]
    assert [c["condition_id"] for c in config.chosen_conditions(doc, ["x", "y"], ["condition_2", "a_2"])["cooccurrence_conditions"]] == ["condition_2"]
    path = tmp_path / "new" / "rules.json"
    config.save_document(str(path), doc)
    assert __import__("json").loads(path.read_text()) == doc and len(list(path.parent.iterdir())) == 1


def test_results_are_kept_until_the_data_change(spark):
    tokens, sentences = corpus(spark, TWO)
    now = [0]
    s = Session(tokens, sentences, stamp=lambda: now[0])
    got = rules({"condition_id": "x", "forms": ["a", "b"]})
    one = s.analyze(got)
    assert s.analyze(got) is one and "Parquet" in type(one.export._jdf.queryExecution().executedPlan()).__name__ or "parquet" in one.export._jdf.queryExecution().toString().lower()
    now[0] = 1
    assert s.analyze(got) is not one and s.analyze(got).export.count() == 1


def test_long_issue_lists_say_how_many_more(spark):
    got = readers.listed(spark.range(7).selectExpr("cast(id as string)").orderBy("id"), 5, "c", "warning", "ingest")
    assert [i.message for i in got] == ["0", "1", "2", "3", "4", "and 2 more"]


def test_details_overwrite_a_summary(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", None), (3, None, "d")], "k long, x string, y string")
    details = spark.createDataFrame([(1, "new", None, 5), (3, "n3", "y3", None), (9, "z", "z", 1)], "k long, x string, y string, more long")
    got = sorted(map(tuple, select.overwritten(rows, details, "k").collect()))
    assert got == [(1, "new", "b", 5), (2, "c", None, None), (3, "n3", "y3", None)]
