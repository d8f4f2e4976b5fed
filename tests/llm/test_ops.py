"""The ten operators against brute force, on small awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chaining, context_mixing, edit_counts, exact_dedup, line_crf, minhash, packing, suffix_dedup, token_files, word_bpe
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words_of(rng, n, alphabet=400):
    return " ".join(f"w{rng.randrange(alphabet)}x" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = words_of(rng, 300)
    near = base.split()
    near[17], near[230] = "other", "changed"
    passage = words_of(random.Random(8), 90, 5000)
    long_ = words_of(rng, 12_000, 900)
    return [
        base, base, base.upper(), " ".join(near), words_of(rng, 40) + " " + passage + " " + words_of(rng, 50), words_of(rng, 70) + "\n" + passage + " " + words_of(rng, 10),
        None, "", " \n\t ", "one", "One", "two words", "Été ÉTÉ ﬁn 日本語 🎉", "a" * 900, "b" + "a" * 900, long_, "### $$$ ***\n" * 30, "Line one here.\nLine one here.\nAnother line of text stands here.", "don't we'll 12345 x@y.com ****",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "x", i, f"extra{i}") for i, t in enumerate(texts())]
    # a row without an id, and columns that clash with names in use
    return spark.createDataFrame([*rows, (None, "no id", "x", 0, None)], "doc_id long, text string, kept string, n long, family string").repartition(3).cache()


@pytest.fixture(scope="module")
def table():
    return {i * 3 + 1: t or "" for i, t in enumerate(texts())}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---------------------------------------------------------------- hashes
def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 4096, 8192])
def test_words_on_which_polynomials_collide(spark, n):
    """Two words that every polynomial hash modulo 2**64 takes for one, through all operators that hash words."""
    from tokenizers import Tokenizer

    x, y = thue_morse(n)
    tail = " ".join(f"t{i}" for i in range(40))
    table = {1: x, 2: y, 3: f"{x} {tail}\n{x}\n{y}", 4: f"{y} {tail}"}
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string").coalesce(1)
    lib = Tokenizer.from_file(word_bpe.default_path())
    rows = packing.pack(df).collect()
    for k, t in table.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want = [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
        assert [r.ids_crc32 for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)] == want
    got = by_id(minhash.near_groups(df, 4))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == brute_near(table, 4)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert by_id(line_crf.verdicts(df, labels))[3].n_dup_lines == 0
    assert all(r.n_known == want for r, want in zip(context_mixing.score(df).orderBy("doc_id").collect(), (2, 2, 44, 42)))
    got = by_id(suffix_dedup.remove_repeats(df))
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == brute_repeats(table, 400)


# ---------------------------------------------------------------- 1
def brute_repeats(table, length):
    raw = {k: t.encode() for k, t in table.items()}
    seen = collections.Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_SEGMENTS, 0])
def test_suffix_dedup(spark, docs, table, empty, monkeypatch, hot):
    settle = suffix_dedup._settle

    def with_limit(length):
        run = settle(length)

        def inner(pdf):
            run.__globals__["HOT_SEGMENTS"] = hot
            return run(pdf)

        return inner

    monkeypatch.setattr(suffix_dedup, "_settle", with_limit)
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == brute_repeats(table, 400)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_difference_cover():
    assert all(any((a + s) % suffix_dedup.PERIOD in suffix_dedup.COVER and (b + s) % suffix_dedup.PERIOD in suffix_dedup.COVER for s in range(suffix_dedup.PERIOD)) for a in range(31) for b in range(31))


def test_suffix_dedup_exchanges_texts_once(spark, monkeypatch):
    """Cutting segments out of the texts and cutting the texts read one exchange, with frequent cores too; a passage of
    more than 50 words is a repeat from 400 bytes on."""
    rng = random.Random(5)
    long_, short = (words_of(rng, 400, 1000)[:n] for n in (430, 380))
    texts = [f"{words_of(rng, 90, 10**6)} {p} {words_of(rng, 90, 10**6)}" for p in (long_, long_, short, short)]
    settle = suffix_dedup._settle
    for hot in (False, True):
        monkeypatch.setattr(suffix_dedup, "_settle", lambda length, hot=hot: lambda pdf: settle(length)(pdf).replace({"kind": {0: 2 if hot else 0}}))
        out = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        got = [r.n_removed for r in sorted(out.collect())]
        assert all(430 <= n <= 434 for n in got[:2]) and got[2:] == [0, 0] and len(long_.split()) > 50 and len(short.split()) > 50
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan



def test_suffix_sort_marks_exactly_the_equal_windows():
    rng = np.random.default_rng(3)
    length, blobs, shifts = 400, [], []
    core = rng.integers(97, 100, 289, dtype=np.uint8)
    for _ in range(40):
        shift = int(rng.integers(0, 112))
        n = int(rng.integers(1, 112 - shift + 1))
        left, right = rng.integers(97, 99, shift, dtype=np.uint8), rng.integers(97, 98, n - 1 + length - 289 - shift, dtype=np.uint8) if n - 1 + length - 289 - shift > 0 else np.zeros(0, np.uint8)
        blob = np.r_[left, core, right][: n - 1 + length]
        if len(blob) == n - 1 + length:
            blobs.append(blob)
            shifts.append(shift)
    size = np.array([len(b) for b in blobs])
    n, begin = size - length + 1, np.cumsum(size) - size
    flags = suffix_dedup.repeated_windows(np.concatenate(blobs), begin, n, np.array(shifts), length)
    windows = [(b[i : i + length].tobytes(), shifts[k] - i) for k, b in enumerate(blobs) for i in range(n[k])]
    seen = collections.Counter(windows)
    assert flags.tolist() == [seen[w] > 1 for w in windows]


# ---------------------------------------------------------------- 2, 3
def ids_of(table, end):
    lib = word_bpe.encoder(word_bpe.default_path()).lib
    return {k: np.array([*lib.encode(t, add_special_tokens=False).ids, end], "<u4") for k, t in table.items()}


def test_packing(docs, table, empty):
    want = {}
    for k, x in ids_of(table, 0).items():
        for p, a in enumerate(range(0, len(x), 512)):
            want[k, p] = (a, len(x[a : a + 512]), zlib.crc32(x[a : a + 512].tobytes()))
    rows = packing.pack(docs, capacity=512).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 512
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_fills_well():
    rng = np.random.default_rng(1)
    lengths = np.r_[rng.integers(1, 2049, 3000), rng.integers(1, 300, 3000)]
    bins, offsets = packing.sum_of_squares(lengths, 2048)
    used = np.bincount(bins, weights=lengths)
    assert used.max() <= 2048 and len(used) <= 1.01 * math.ceil(lengths.sum() / 2048)
    assert len(packing.sum_of_squares(np.array([2048, 2048, 1]), 2048)[0]) == 3


def test_token_files(spark, docs, table, empty, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"))
    start, want = 0, {}
    ids = ids_of(table, 2)
    for k in sorted(ids):
        want[k] = (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])
    assert {k: (r.start, r.n_tokens, r.ids_crc32) for k, r in by_id(token_files.digests(spark, str(tmp_path / "t"))).items()} == want
    assert {k: (r.start, r.n_tokens) for k, r in by_id(token_files.read_metadata(spark, str(tmp_path / "t"))).items()} == {k: v[:2] for k, v in want.items()}
    assert token_files.read_tokens(spark, str(tmp_path / "t"), [4]).first().tokens == ids[4].tolist()
    token_files.write_tokens(empty, str(tmp_path / "e"))
    assert token_files.digests(spark, str(tmp_path / "e")).count() == 0


def test_token_files_are_laid_out_for_selective_reads(spark, tmp_path):
    """Encodings, row groups in order of ids, and page indexes of the files; a selective read opens few row groups."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(3)
    df = spark.createDataFrame([(i, words_of(rng, 120)) for i in range(600)], "doc_id long, text string")
    token_files.write_tokens(df, str(tmp_path / "t"), row_group_bytes=16 << 10, page_bytes=2 << 10)
    seen = 0
    for path in sorted(glob.glob(f"{tmp_path}/t/*.parquet")):
        meta = pq.ParquetFile(path).metadata
        assert meta.num_row_groups > 1
        groups = []
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids, tokens = columns["doc_id"], columns["tokens.list.element"]
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"} & set(tokens.encodings) and {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
            assert all(c.has_offset_index and c.has_column_index for c in (ids, columns["n_tokens"]))
            groups.append((ids.statistics.min, ids.statistics.max))
        assert groups == sorted(groups) and all(a[1] < b[0] for a, b in zip(groups, groups[1:]))
        assert sum(a <= 77 <= b for a, b in groups) <= 1
        seen += meta.num_rows
    assert seen == 600
    plan = token_files.read_tokens(spark, str(tmp_path / "t"), [77])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(doc_id,77)" in plan.replace("In(doc_id, [77])", "EqualTo(doc_id,77)") or "doc_id" in plan.split("PushedFilters:")[1][:60]
    read = token_files.read_metadata(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in read


def test_added_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    from tessera.llm.common import Chunk

    fresh = Tokenizer.from_file(word_bpe.default_path())
    texts = ["plain words, first.", "a <|endoftext|> b", "", "A<|startoftext|>B, c<|endoftext|>", "<|ENDOFTEXT|> Kept <|endoftext|", "<|endoftext|><|endoftext|>", "plain again", "<|startoftext|>"]
    raw = [t.encode() for t in texts]
    enc = word_bpe.WordEncoder(word_bpe.default_path())
    for part in (raw, raw[1:2], raw[:1], raw[::-1]):
        chunk = Chunk(np.arange(len(part)), np.frombuffer(b"".join(part), np.uint8), np.r_[0, np.cumsum([len(b) for b in part])].astype(np.int64))
        ids, offs = enc.encode(chunk)
        assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [fresh.encode(b.decode(), add_special_tokens=False).ids for b in part]
    assert enc.encode(Chunk(np.arange(1), np.frombuffer(raw[1], np.uint8), np.array([0, len(raw[1])])))[0].tolist() == [320, 49407, 321]


def test_pieces_forget_and_grow():
    enc = word_bpe.WordEncoder(word_bpe.default_path())
    enc.memory = word_bpe.Memory(4)
    from tessera.llm.common import Chunk

    for t in ("one two three four five six seven eight nine ten eleven twelve", "one thirteen fourteen.", "É. é, x́! don'. a_b 5.,"):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert enc.encode(Chunk(np.array([1]), raw, np.array([0, len(raw)])))[0].tolist() == enc.lib.encode(t, add_special_tokens=False).ids


# ---------------------------------------------------------------- 4
def brute_near(table, size):
    sets = {}
    for k, t in table.items():
        w = WORD.findall(t.translate(LOWER))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def test_near_dedup(docs, table, empty):
    got = by_id(minhash.near_groups(docs, 4))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == brute_near(table, 4)
    assert minhash.near_groups(empty).count() == 0
    kept = {r.doc_id for r in minhash.drop_near(docs.where("doc_id is not null")).collect()}
    assert kept == {k for k, v in brute_near(table, 5).items() if v[2]}


def test_a_large_family_in_blocks(spark, monkeypatch):
    """Copies with more and more changes: links form chains, so that stars around one document would lose some."""
    rng = random.Random(2)
    base, table = words_of(rng, 200, 10**6).split(), {}
    for k in range(60):
        t = list(base)
        for _ in range(rng.randrange(0, 12)):
            t[rng.randrange(200)] = f"new{rng.random()}"
        table[k] = " ".join(t)
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    got = by_id(minhash.near_groups(df, 4))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == brute_near(table, 4)


def test_recall_of_links_in_a_crowd(spark):
    """Pairs at a similarity of 0.80 to 0.85 among many texts that are 0.2 to 0.4 like them: every link is found."""
    rng = random.Random(41)
    base, table = words_of(rng, 240, 10**6).split(), {}

    def changed(t, share):
        t = list(t)
        at = rng.randrange(0, max(1, int(len(t) * (1 - share))))
        t[at : at + int(len(t) * share)] = words_of(rng, int(len(t) * share), 10**6).split()
        return t

    for i in range(250):
        one = changed(base, rng.uniform(0.45, 0.65))
        table[2 * i] = " ".join(one)
        table[2 * i + 1] = " ".join(changed(one, 0.08) if i % 3 else changed(base, 0.5))
    want = brute_near(table, 4)
    got = by_id(minhash.near_groups(spark.createDataFrame(list(table.items()), "doc_id long, text string"), 4))
    linked = [k for k, v in want.items() if not v[2]]
    assert len(linked) > 100 and {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == want


def test_hot_stars_and_families(spark, monkeypatch):
    """The plans for nodes and families with many rows give what the plain ones give."""
    import tessera.llm.components as comp
    import tessera.llm.pairs as pairs

    links = spark.createDataFrame([(10, 100 + i) for i in range(1500)] + [(5, 1599)] + [(5000 + i, 5001 + i) for i in range(20)], "a long, b long")
    want = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert len(want) == 1523 and set(want.values()) == {5, 5000}
    rows = spark.createDataFrame([(1, i) for i in range(1200)] + [(2, 1), (3, 1)], "k long, x long")
    sizes = rows.where("k <> 3").groupBy("k").count().withColumnRenamed("count", "n")
    plain = sorted(map(tuple, pairs.join_sizes(rows, sizes, "k", 1202).select("k", "x", "n").collect()))
    monkeypatch.setattr(comp, "FEW", 0)
    monkeypatch.setattr(pairs, "FEW", 0)
    assert {r.node: r.component for r in components(links, "a", "b").collect()} == want
    assert sorted(map(tuple, pairs.join_sizes(rows, sizes, "k", 1202).select("k", "x", "n").collect())) == plain and len(plain) == 1201


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 5), (5, 3), (3, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 141)} | {1: 1, 3: 1, 5: 1}
    assert components(links.limit(0), "a", "b").count() == 0


# ---------------------------------------------------------------- 5, 7
def tik():
    import public_tokenizers
    import tiktoken

    m = byte_bpe.model(byte_bpe.default_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.ranks, special_tokens={})


def test_byte_bpe(docs, table, empty):
    enc = tik()
    got = by_id(byte_bpe.digests(docs))
    for k, t in table.items():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(table) and byte_bpe.digests(empty).count() == 0
    assert by_id(byte_bpe.decode(byte_bpe.encode(docs)))[37].bytes.decode() == table[37]


def test_matrix_and_heap_agree():
    m, rng = byte_bpe.model(byte_bpe.default_path()), random.Random(4)
    pieces = [bytes(rng.choice(b"abethinos \xc3\xa9") for _ in range(rng.randrange(2, 90))) for _ in range(400)]
    for p, x in zip(pieces, m.encode_pieces(pieces)):
        assert x.tolist() == (m._by_heap(p).tolist() if p not in m.ranks else [m.ranks[p]])


def test_edit_counts(docs, table, empty):
    enc = tik()
    got = by_id(edit_counts.edit_counts(docs))
    for k, t in table.items():
        edited = t
        for a, n, new in edit_counts.masking_edits(t):
            edited = edited[:a] + new + edited[a + n :]
        assert (got[k].n_tokens, got[k].n_tokens_edited, got[k].edited_sha256) == (len(enc.encode_ordinary(t)), len(enc.encode_ordinary(edited)), hashlib.sha256(edited.encode()).hexdigest())
    assert got[55].n_edits == 3 and edit_counts.edit_counts(empty).count() == 0
    given = docs.withColumn("e", F.expr("array(named_struct('start', 2, 'length', 3, 'replacement', 'zz'), named_struct('start', 99999, 'length', 9, 'replacement', null))"))
    assert by_id(edit_counts.edit_counts(given, edits_col="e"))[1].n_tokens_edited == len(enc.encode_ordinary(table[1][:2] + "zz" + table[1][5:]))


def test_token_tree_against_recounting():
    m, enc, rng = byte_bpe.model(byte_bpe.default_path()), tik(), random.Random(6)
    for t in texts():
        t = (t or "")[:3000]
        tree = edit_counts.TokenTree(m.pattern.findall(t), m)
        for _ in range(8):
            a, n, new = rng.randint(0, len(t)), rng.choice([0, 1, 7, 400]), rng.choice(["", " ", "  the", "'s", "\n", "42"])
            t = t[:a] + new + t[a + n :]
            tree.replace(a, n, new)
            assert tree.text == t and tree.count == len(enc.encode_ordinary(t))
        assert tree.prefix_count(len(t)) == tree.count


#: What makes pre-tokens depend on what stands behind them: runs of spaces, contractions, marks, digits, other scripts.
AWKWARD = [" ", " ", "  ", "\n", "\n\n", "\t", "\u3000", "a", "ll", "l", "s", "re", "'", "'", "’", "12", "345", ".", ",!", "###", "é", "日本", "🎉", "<|endoftext|>"]


def awkward(rng, most):
    return "".join(rng.choice(AWKWARD) for _ in range(rng.randrange(most)))


def test_ten_thousand_awkward_edits():
    m, enc, rng = byte_bpe.model(byte_bpe.default_path()), tik(), random.Random(31)
    tree = edit_counts.TokenTree(m.pattern.findall("x\n\n12345 y"), m)
    tree.replace(3, 5, " <masked> ")
    assert tree.count == len(enc.encode_ordinary("x\n\n <masked>  y"))
    for k in range(4000):
        t = awkward(rng, 14)
        tree = edit_counts.TokenTree(m.pattern.findall(t), m)
        for _ in range(rng.randint(1, 4)):
            a, n, new = rng.randint(0, len(t)), rng.randrange(5), awkward(rng, 5)
            t = t[:a] + new + t[a + n :]
            tree.replace(a, n, new)
            assert tree.text == t and tree.pieces[0] == m.pattern.findall(t), (k, t)
        assert tree.count == len(enc.encode_ordinary(t)), (k, t)


def test_awkward_edits_through_kept_trees(spark):
    enc, rng = tik(), random.Random(37)
    texts_, edits, want = [], [], []
    for k in range(600):
        t = awkward(rng, 30)
        texts_.append((k, t))
        todo = []
        for _ in range(rng.randint(0, 3)):
            a, n, new = rng.randint(0, len(t)), rng.randrange(4), awkward(rng, 4)
            todo.append((a, n, new))
            t = t[:a] + new + t[a + n :]
        edits.append((k, todo))
        want.append((k, len(enc.encode_ordinary(t))))
    trees = edit_counts.build_trees(spark.createDataFrame(texts_, "doc_id long, text string"))
    after = edit_counts.apply_edits(trees, spark.createDataFrame(edits, "doc_id long, edits array<struct<start:int,length:int,replacement:string>>"))
    assert sorted((r.doc_id, r.n_tokens) for r in edit_counts.tree_counts(after).collect()) == want


def test_leaves_split_and_edits_stay_local():
    m, enc = byte_bpe.model(byte_bpe.default_path()), tik()
    t = words_of(random.Random(1), 4000)
    tree = edit_counts.TokenTree(m.pattern.findall(t), m)
    new = " inserted" * 1000
    tree.replace(500, 3, new)
    t = t[:500] + new + t[503:]
    assert tree.text == t and tree.count == len(enc.encode_ordinary(t)) and max(len(x) for x, _ in tree.leaves) <= edit_counts.MOST
    again = tree.reencoded
    for k in range(200):  # none of these reads or encodes more than its neighbourhood
        tree.replace(len(t) - 50 * k - 60, 1, "'l")
        t = t[: len(t) - 50 * k - 60] + "'l" + t[len(t) - 50 * k - 59 :]
    assert tree.text == t and tree.count == len(enc.encode_ordinary(t)) and tree.reencoded - again < 200 * 12


def test_edits_of_rows_that_repeat_an_id(spark):
    schema = "doc_id long, text string, e array<struct<start:int,length:int,replacement:string>>"
    rows = [(1, "one two three", [(0, 3, "zzz")]), (1, "one two three", None), (2, "a b", [None, (None, 1, "x"), (2, None, None), (0, 1, None)]), (3, None, [(5, 5, "new")])]
    got = edit_counts.edit_counts(spark.createDataFrame(rows, schema).coalesce(1), edits_col="e").collect()
    sha = [hashlib.sha256(x).hexdigest() for x in (b"zzz two three", b"one two three", b" b", b"new")]
    assert [(r.doc_id, r.n_edits, r.edited_sha256) for r in got] == [(1, 1, sha[0]), (1, 0, sha[1]), (2, 2, sha[2]), (3, 1, sha[3])]


def test_trees_are_kept_and_updated(spark, docs, table, empty):
    enc = tik()
    trees = edit_counts.build_trees(docs)
    assert {r.doc_id: r.n_tokens for r in edit_counts.tree_counts(trees).collect()} == {k: len(enc.encode_ordinary(t)) for k, t in table.items()}
    edits = spark.createDataFrame([(1, [(2, 3, "zz"), (9999, 1, " end")]), (49, [(0, 10, "")]), (999, [(0, 0, "x")])], "doc_id long, edits array<struct<start:int,length:int,replacement:string>>")
    after = edit_counts.apply_edits(trees, edits)
    want = dict(table)
    want[1] = want[1][:2] + "zz" + want[1][5:] + " end"
    want[49] = want[49][10:]
    got = by_id(after)
    assert {k: r.text for k, r in got.items()} == want and 0 < got[1].n_reencoded < 12 and got[4].n_reencoded == 0
    assert {r.doc_id: r.n_tokens for r in edit_counts.tree_counts(after).collect()} == {k: len(enc.encode_ordinary(t)) for k, t in want.items()}
    assert edit_counts.apply_edits(edit_counts.build_trees(empty), edits).count() == 0


# ---------------------------------------------------------------- 6
def base_counts(t):
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, docs, table, empty):
    labels = spark.createDataFrame([(1, 1, 0), (16, 1, 0), (49, 0, 0), (55, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(line_crf.verdicts(docs, labels))
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for k, r in got.items()} == {k: base_counts(t) for k, t in table.items()}
    assert all(not (r.kept and r.base_failed) for r in got.values()) and got[1].kept
    assert line_crf.verdicts(empty, labels).count() == 0 and line_crf.drop_rejected(empty, labels).count() == 0
    left = line_crf.drop_rejected(docs, labels)  # the row without an id has two words
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, r in got.items() if r.kept) and left.columns == docs.columns
    assert all(r.kept != r.base_failed for r in line_crf.verdicts(docs, labels.limit(0)).collect())


def test_rejected_rows_are_told_apart_by_text(spark):
    good = words_of(random.Random(3), 60, 10**6)
    rows = [(1, good), (1, "too short"), (None, good), (None, "short"), (None, None)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    left = line_crf.drop_rejected(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, good), (1, good)]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    crf = line_crf.Crf(rng.normal(size=(len(line_crf.FEATURES), 2)), rng.normal(size=(2, 2)))
    masks, row = rng.integers(0, 1 << len(line_crf.FEATURES), 18).astype(np.int32), np.repeat([0, 2, 3], [7, 1, 10])
    got, e = crf.viterbi(masks, row, 5), line_crf.unpack(masks) @ crf.emission
    for r in (0, 2, 3):
        at = np.flatnonzero(row == r)

        def total(path, at=at):
            return sum(e[i, y] for i, y in zip(at, path)) + sum(crf.transition[a, b] for a, b in zip(path, path[1:]))

        best = max((tuple(int(c) for c in np.binary_repr(v, len(at))) for v in range(1 << len(at))), key=total)
        assert tuple(got[at]) == best


def test_crf_marks_lines_in_mixed_documents(spark):
    """Boilerplate inside good documents, junk documents, and documents that change from one to the other."""
    rng = random.Random(1)

    def prose():
        return f"Here {words_of(rng, 12, 10**6)} ends."

    footers = ["Home | About | Contact", "Share this page with your friends now.", "All rights reserved."]
    rows, labels, truth = [], [], {}
    for i in range(60):
        lines = [prose() for _ in range(6)]
        where = rng.randrange(1, 6)
        lines.insert(where, footers[i % 3])
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, 0))
        truth[i] = [k != where for k in range(7)]
    for i in range(100, 140):
        rows.append((i, "\n".join(" ".join(f"{w}{rng.choice(['!!', '***', '$$$'])}" for w in words_of(rng, 9, 10**6).upper().split()) for _ in range(6))))
        labels.append((i, 0, 0))
        truth[i] = [False] * 6
    for i in range(200, 220):  # not labelled: prose, then junk
        cut = rng.randrange(2, 6)
        rows.append((i, "\n".join([prose() for _ in range(cut)] + [" ".join(f"{w}***" for w in words_of(rng, 9, 10**6).upper().split()) for _ in range(8 - cut)])))
        truth[i] = [True] * cut + [False] * (8 - cut)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = line_crf.measured(df)
    crf = line_crf.fit_on(lines, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    right = total = 0
    for r in lines.collect():
        masks = np.array(r.masks, np.int32)
        got = crf.viterbi(masks, np.zeros(len(masks), np.int64), 1)
        if r.doc_id >= 200:
            assert got.astype(bool).tolist() == truth[r.doc_id]
        right, total = right + int((got.astype(bool) == np.array(truth[r.doc_id])).sum()), total + len(masks)
    assert right >= 0.98 * total
    verdict = by_id(line_crf.verdicts(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert all(r.kept == (k < 60 or k >= 200 and 2 * r.content_words >= r.n_words) for k, r in verdict.items())
    shares = [r.content_words / r.n_words for k, r in verdict.items() if k < 60 or k >= 200]
    assert all(0 < x < 1 for x in shares)


def test_copies_do_not_make_lines_widespread(spark):
    text = "\n".join(f"Line {i} of a page has {words_of(random.Random(i), 9, 10**6)}." for i in range(5))
    lines = line_crf.measured(spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string"))
    assert all(m >> line_crf.BIT["widespread"] & 1 == 0 for r in lines.collect() for m in r.masks)


def test_fit_against_the_likelihood():
    """The gradient's end point is a maximum of the conditional likelihood of the pairs."""
    rng = np.random.default_rng(5)
    pairs = collections.Counter({(int(q), int(a), int(b)): int(n) for q, a, b, n in zip(rng.integers(0, 2, 40), rng.integers(0, 8, 40), rng.integers(-1, 8, 40), rng.integers(1, 9, 40))})

    def likelihood(crf):
        total = 0.0
        for (q, a, b), n in pairs.items():
            x, ya = line_crf.unpack(np.array([a, max(b, 0)])) @ crf.emission, line_crf.targets(np.array([q]), np.array([a]))[0]
            if b < 0:
                total += n * (x[0, ya] - np.logaddexp(*x[0]))
            else:
                yb = line_crf.targets(np.array([q]), np.array([b]))[0]
                z = x[0][:, None] + x[1][None] + crf.transition
                total += n * (z[ya, yb] - np.logaddexp.reduce(z.ravel()))
        return total

    best = line_crf.fit(pairs, rounds=3000, decay=0.0)
    top = likelihood(best)
    for _ in range(20):
        other = line_crf.Crf(best.emission + rng.normal(size=best.emission.shape) * 0.05, best.transition + rng.normal(size=(2, 2)) * 0.05)
        assert likelihood(other) <= top + 1e-2


# ---------------------------------------------------------------- 8
def test_exact_dedup(docs, table, empty):
    groups = collections.defaultdict(list)
    for k, t in table.items():
        groups[t.translate(LOWER)].append(k)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, keep="max").collect()}
    for t, members in groups.items():
        for k in members:
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(members), len(members), k == max(members), hashlib.sha256(t.encode()).hexdigest())
    assert got[None].group_size == 1 and exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, *sorted(min(m) for m in groups.values())] and kept.columns == docs.columns


def test_no_row_is_lost_for_its_id(spark):
    """Rows without an id, and rows that repeat one, through every dropping operator."""
    a, b, c = (words_of(random.Random(i), 80, 10**6) for i in (1, 2, 3))
    rows = [(1, a), (2, a.upper()), (None, a), (None, b), (None, b), (None, c), (3, c + " x"), (3, "other words " + c[:100]), (4, None), (4, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)

    def left(d):
        return collections.Counter((r.doc_id, r.text) for r in d.collect())

    assert left(exact_dedup.drop_copies(df)) == collections.Counter([(1, a), (None, b), (None, c), (3, c + " x"), (3, "other words " + c[:100]), (4, None)])
    all_ = collections.Counter((i, t) for i, t in rows)
    assert left(minhash.drop_near(df)) == all_ - collections.Counter([(2, a.upper())])
    assert left(chaining.drop_passages(df)) == all_ - collections.Counter([(2, a.upper())])
    for f in (exact_dedup.drop_copies, minhash.drop_near, chaining.drop_passages):
        assert f(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9
def test_passages(docs, table, empty):
    got = {(r.doc_id, r.other_id): r for r in chaining.passages(docs).collect()}
    r = got[16, 13]
    assert r.n_words >= 90 and r.identity > 0.9 and words_of(random.Random(8), 90, 5000).encode() in table[16].encode()[r.start : r.end]
    assert {k for k, _ in got} == {4, 7, 10, 16}
    left = {x.doc_id: x.text for x in chaining.drop_passages(docs.where("doc_id is not null")).collect()}
    assert left[13] == table[13] and len(WORD.findall(left[16])) <= 85 and 4 not in left and chaining.passages(empty).count() == 0


def test_fuzzy_passage_and_chain_score(spark):
    a = words_of(random.Random(1), 80, 10**6).split()
    b = a[:20] + ["inserted"] + a[20:50] + ["swapped", "words"] + a[52:]
    rows = [(1, "x y z " + " ".join(a)), (2, words_of(random.Random(2), 30, 10**6) + " " + " ".join(b)), (3, words_of(random.Random(3), 200, 10**6))]
    (r,) = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (r.doc_id, r.other_id) == (2, 1) and r.n_words >= 50 and 0.9 < r.identity < 1
    # the best chain against all subsets
    rng = random.Random(7)
    for _ in range(30):
        points = [(rng.randrange(60), rng.randrange(60)) for _ in range(9)]

        def best(points=points):
            f = {}
            for i, (p, q) in enumerate(sorted(points)):
                f[i] = 1 + max([0, *(f[j] - 0.05 * (p - a + q - b) for j, (a, b) in enumerate(sorted(points)[:i]) if a < p and b < q)])
            return max(f.values())

        top = chaining.chains(np.array([p for p, _ in points]), np.array([q for _, q in points]), 0.05, 1000)[0]
        assert abs(top[4] - 0.05 * (top[1] - top[0] + top[3] - top[2]) - best()) < 1e-9


def test_a_long_chain_hides_nothing_behind_a_gap(spark):
    """A copy with a paragraph inserted, and chains with the production gap bound against all predecessors."""
    rng = random.Random(11)
    a = words_of(rng, 2200, 10**6).split()
    b = a[:1000] + words_of(rng, 60, 10**6).split() + a[1000:1950]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    got = sorted((r.n_words, r.identity) for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(950, 1.0), (1000, 1.0)]
    reach = chaining.MAX_GAP + chaining.K
    first = [(p, p) for p in range(0, 1000, 5)]
    for trial in range(20):
        second = [(1060 + p, 1000 + p) for p in range(0, 950, 5)]
        noise = [(rng.randrange(2100), rng.randrange(2100)) for _ in range(trial * 20)]
        points = sorted({p: (p, q) for p, q in noise + first + second}.values())
        f = []
        for p, q in points:
            f.append(1 + max([0, *(f[j] - chaining.GAP_COST * (p - x + q - y) for j, (x, y) in enumerate(points[: len(f)]) if 0 < p - x <= reach and 0 < q - y <= reach)]))
        found = chaining.chains(np.array([p for p, _ in points]), np.array([q for _, q in points]))
        top = found[0]
        assert abs(top[4] - chaining.GAP_COST * (top[1] - top[0] + top[3] - top[2]) - max(f)) < 1e-9
        assert any(c[0] <= 1060 and c[1] >= 2005 and c[4] >= 190 for c in found) and sum(c[4] for c in found) == len(points)


def test_every_place_and_every_holder_of_a_passage(spark):
    """A passage twice in a later document, one whose halves two earlier documents hold, and one of over 4096 words."""
    rng = random.Random(21)
    fill = lambda n: words_of(rng, n, 10**6)
    p, q, long_ = words_of(rng, 60, 10**6), words_of(rng, 80, 10**6).split(), words_of(rng, 9000, 10**6)
    rows = [
        (1, fill(30) + " " + p + " " + fill(30)), (2, f"{fill(20)} {p} {fill(200)} {p} {fill(20)}"),
        (11, fill(30) + " " + " ".join(q[:40]) + " " + fill(30)), (12, fill(30) + " " + " ".join(q[40:]) + " " + fill(30)),
        (13, fill(30) + " " + " ".join(q) + " " + fill(30)), (14, fill(50) + " " + " ".join(q) + " " + fill(10)),
        (21, long_), (22, fill(40) + " " + long_),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        left = {r.doc_id: r.text for r in chaining.drop_passages(df.repartition(parts)).collect()}
        assert p in left[1] and p not in left[2] and len(WORD.findall(left[2])) <= 242
        assert " ".join(q) in left[13] and len(WORD.findall(left[14])) <= 62
        assert left[21] == long_ and len(WORD.findall(left[22])) <= 42


def brute_passages(rows, size=50):
    """Exact runs of ``size`` words or more that an earlier document has: covered word places per document."""
    seen, covered = set(), {}
    for doc, t in sorted(rows):
        w = WORD.findall(t.translate(LOWER))
        grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        covered[doc] = {j for i, g in enumerate(grams) if g in seen for j in range(i, i + size)}
        seen.update(grams)
    return covered


def test_passages_against_all_runs(spark):
    """Whatever exact run of 50 words or more an earlier document has is covered; texts without one are left alone."""
    rng = random.Random(31)
    pool = [words_of(rng, rng.choice([50, 51, 60, 90, 200]), 10**6) for _ in range(12)]
    pool += [" ".join(p.split()[k : k + 55]) for p in pool for k in (0, 7) if len(p.split()) > 70]
    rows = []
    for d in range(60):
        parts = [words_of(rng, rng.randrange(5, 60), 10**6) for _ in range(4)]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(pool))
        rows.append((d, " ".join(parts)))
    want = brute_passages(rows)
    found = collections.defaultdict(set)
    table = dict(rows)
    for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        raw = table[r.doc_id].encode()
        first = len(WORD.findall(raw[: r.start].decode()))
        found[r.doc_id] |= set(range(first, first + r.n_words))
    missed = sum(len(want[d] - found[d]) for d in want)
    assert missed == 0 and all(len(found[d] - want[d]) <= 6 * (1 + len(want[d]) // 50) if want[d] else not found[d] for d in want)


def test_runs_of_fifty_words_with_overlapping_holders(spark):
    """Passages of exactly 50 words, of which earlier documents hold 49 words, overlapping parts, or all."""
    rng, rows = random.Random(41), []
    for i in range(40):
        fill = lambda: words_of(rng, 30, 10**6)
        p = words_of(rng, 50, 10**6).split()
        holders = [p[:49], p[1:], p[:30], p[20:], p[:49], p, p[3:], p[:49] + ["x"], p]
        rows += [(1000 * i + k, f"{fill()} {' '.join(h)} {fill()}") for k, h in enumerate(holders)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        got = collections.defaultdict(list)
        for r in chaining.passages(df.repartition(parts)).collect():
            got[r.doc_id].append(r)
        assert {d for d in got} == {1000 * i + 8 for i in range(40)} and all(r.n_words >= 50 and r.other_id % 1000 == 5 for x in got.values() for r in x)


def test_recall_at_low_identity(spark):
    """100-word passages in which 18 words are others: at least nine of ten are found."""
    rng, rows = random.Random(43), []
    for i in range(100):
        p = words_of(rng, 100, 10**6).split()
        q = list(p)
        for k in rng.sample(range(100), 18):
            q[k] = "edit" + words_of(rng, 1, 10**6)
        rows += [(i, f"{words_of(rng, 40, 10**6)} {' '.join(p)}"), (1000 + i, f"{' '.join(q)} {words_of(rng, 40, 10**6)}")]
    got = {(r.doc_id, r.other_id) for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((1000 + i, i) in got for i in range(100)) >= 90


def test_no_internal_name_meets_a_column(spark):
    """Every dropping stage with columns of all names that the operators use themselves."""
    from tessera.llm import common

    names = ["__id", "__left", "__spans", "__t", "__sha", "__i", "__s", "__n", "__key", "__h", "__k", "key", "kept", "row", "left", "id", "sha", "spans", "family", "rep", "doc", "other", "a", "b", "text_sha256", "component_id"]
    passage = words_of(random.Random(8), 70, 5000)
    rows = [(1, words_of(random.Random(1), 60) + " " + passage), (2, passage + " " + words_of(random.Random(2), 60)), (3, words_of(random.Random(1), 60) + " " + passage), (4, "too short")]
    docs = spark.createDataFrame([(i, t, len(t), *(f"{n}{i}" for n in names)) for i, t in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for stage, stay in ((lambda d: line_crf.drop_rejected(d, labels), {1, 2, 3}), (exact_dedup.drop_copies, {1, 2, 4}), (minhash.drop_near, {1, 2, 4}), (lambda d: chaining.drop_passages(d, length_col="n_chars"), {1, 2, 4})):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert {r.doc_id for r in got} == stay and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names) and all(r.n_chars == len(r.text) for r in got)
    assert common.unpacked(docs.select(F.struct("*").alias("row")), docs).columns == docs.columns


def test_seeds_survive_the_exchange():
    rng = np.random.default_rng(4)
    for dtype in (chaining.SEED, chaining.LONG, chaining.MATCH):
        for n in (0, 1, 500):
            s = np.frombuffer(rng.bytes(dtype.itemsize * n), dtype).copy()
            got = chaining._unpacked(chaining._packed(s), dtype)
            assert sorted(r.tobytes() for r in got) == sorted(r.tobytes() for r in s)


def test_rows_without_an_id_and_odd_names_pass_the_cutting(spark):
    passage = words_of(random.Random(8), 70, 5000)
    rows = [(1, "x " + passage, 1, 1, "p"), (2, passage + " y", 2, 2, "q"), (2, passage + " y", 2, 2, "q"), (None, passage, 3, 3, "r"), (5, None, 4, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, rest int, `a.b` int, `c``d` string")
    out = chaining.drop_passages(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    want = [(1, "x " + passage, 1, 1, "p"), (2, " y", 2, 2, "q"), (2, " y", 2, 2, "q"), (None, passage, 3, 3, "r"), (5, None, 4, 4, None)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_edited_passages_are_found_whole(spark):
    """Two dropped words, and an edit every 12 words (identity 0.92), cost no part of a passage."""
    rng = random.Random(1)
    a = words_of(rng, 80, 10**6).split()
    c = words_of(rng, 240, 10**6).split()
    b, d = a[:20] + ["inserted"] + a[20:50] + a[52:], list(c)
    for k in range(11, 240, 12):
        d[k] = f"edit{k}"
    rows = [(1, "x y z " + " ".join(a)), (2, words_of(rng, 30, 10**6) + " " + " ".join(b)), (3, " ".join(c)), (4, words_of(rng, 30, 10**6) + " " + " ".join(d))]
    got = {r.doc_id: r for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == {2, 4} and got[2].other_id == 1 and got[2].n_words >= 75 and 0.9 < got[2].identity < 1
    assert got[4].other_id == 3 and got[4].n_words >= 220 and 0.9 < got[4].identity < 1


# ---------------------------------------------------------------- 10
def test_scores(docs, table, empty):
    tokens = {k: [*WORD.findall(t.translate(LOWER)), None] for k, t in table.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in table}
    count = collections.Counter(w for k in table if not held[k] for w in tokens[k])
    total, distinct = sum(count.values()), len(count)
    got = by_id(context_mixing.score(docs))
    for k, w in tokens.items():
        r = got[k]
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(count[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and math.isfinite(r.score) and r.score < 0
    assert got[46].bits_per_byte < 3 and context_mixing.score(empty).count() == 0


def test_scores_do_not_depend_on_the_partitioning(docs):
    a, b = by_id(context_mixing.score(docs)), by_id(context_mixing.score(docs.repartition(1).orderBy("n")))
    assert all(abs(a[k].score - b[k].score) < 1e-3 * abs(a[k].score) for k in a)


def coded_in_process(table, parts=2, buckets=3):
    """The stages of the operator on Arrow tables, without Spark."""
    import pandas as pd
    import pyarrow as pa

    batch = pa.record_batch([pa.array(list(table), pa.int64()), pa.array(list(table.values()))], ["doc_id", "text"])
    payloads = collections.defaultdict(list)
    for b in context_mixing._deal(parts)([batch]):
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            payloads[p].append(x)
    groups = {p: pa.table({"part": pa.array([p] * len(x), pa.int32()), "payload": x}) for p, x in payloads.items()}
    asked = pa.concat_tables([context_mixing._ask(buckets)(g) for g in groups.values()]).to_pandas()
    answers = pd.concat([context_mixing._count(g) for _, g in asked.groupby(["kind", "bucket"])])
    return pa.concat_tables([context_mixing._coded(buckets)(g, pa.Table.from_pandas(answers[answers["part"] == p], preserve_index=False)) for p, g in groups.items()])


def test_counts_of_sequences_against_counting(table):
    """Levels, the bits of their shares and the words to spell, token by token, from plain counts of the other documents."""
    texts = dict(table) | {200 + i: words_of(random.Random(i % 7), 30 + i, 60) for i in range(40)}
    tokens = {k: ["<<", "<", *WORD.findall(t.translate(LOWER)), ">"] for k, t in texts.items()}
    train = {k for k in texts if zlib.crc32(str(k).encode()) % 10}

    def grams(w, last):
        return [tuple(w[i - n + 1 : i + 1]) for n in (1, 2, 3) for i in range(2, last)]

    counts = collections.Counter(g for k in train for g in grams(tokens[k], len(tokens[k])))
    want = {}
    for k, w in tokens.items():
        own = collections.Counter(grams(w, len(w))) if k in train else collections.Counter()
        n = lambda g, i: counts[g] - own[g] + collections.Counter(grams(w, i))[g]  # noqa: B023, E731
        levels, bits, novel = [], 0.0, []
        docs = counts[(">",)] - (k in train)
        for i in range(2, min(len(w), 90)):
            by_one = n((w[i - 1],), i - 1) if i > 2 else docs
            by_two = n((w[i - 2], w[i - 1]), i - 1) if i > 2 else 0
            if by_two > 0 and (x := n(tuple(w[i - 2 : i + 1]), i)) > 0:
                levels.append(0)
                bits -= math.log2(x / by_two)
            elif by_one > 0 and (x := n((w[i - 1], w[i]), i)) > 0:
                levels.append(1)
                bits -= math.log2(x / by_one)
            elif (x := n((w[i],), i)) > 0:
                levels.append(2)
                bits -= math.log2(x)
            else:
                levels.append(3)
                novel.append("\n" if w[i] == ">" else w[i])
        want[k] = levels, bits, novel
    got = coded_in_process(texts)
    seen = set()
    for part in got.to_pylist():
        first, spelled = 0, 0
        codes, raw, at = np.frombuffer(part["codes"], np.uint16), part["novel"], np.r_[0, np.cumsum(part["novel_sizes"])]
        for k, n, b in zip(part["ids"], part["n_tokens"], part["bits"]):
            level = (codes[first : first + n] & 3).tolist()
            levels, bits, novel = want[k]
            assert level[:88] == levels
            if n <= 88:
                assert abs(b - bits) < 1e-6
            words = [raw[at[spelled + j] + context_mixing.BACK : at[spelled + j + 1] - 1].decode() for j in range(level.count(3))]
            assert words[: len(novel)] == novel
            first, spelled = first + n, spelled + level.count(3)
            seen.add(k)
    assert seen == set(texts)


def test_online_mixer_against_a_loop():
    rng = np.random.default_rng(2)
    n, models, sets, block = 400, context_mixing.MODELS, context_mixing.SETS, context_mixing.BLOCK
    mixer = context_mixing.Mixer(context_mixing.Code(np.ones(256, np.int64)), np.zeros((models, 2 << context_mixing.SLOT_BITS), np.int64))
    x, bit, kind = rng.integers(-126, 127, (n, models)).astype(np.int8), rng.integers(0, 2, n).astype(np.int8), rng.integers(0, sets, n).astype(np.int8)
    per = np.array([0, 1, 150, 32, 217])
    want, at = [], 0
    for m in per:
        w, bias, cost = np.full((sets, models), context_mixing.WEIGHT), np.zeros(context_mixing.BIASES), 0.0
        for b in range(0, m, block):
            dw, db = np.zeros_like(w), np.zeros_like(bias)
            for i in range(at + b, at + min(b + block, m)):
                v = x[i] / 16
                dot = min(max(float(w[kind[i]] @ v), -15.9), 15.9)
                r = int((dot + 16) * context_mixing.BIASES / 32)
                p = 1 / (1 + math.exp(-(dot + bias[r])))
                cost -= math.log2(p if bit[i] else 1 - p)
                dw[kind[i]] += context_mixing.RATE * (bit[i] - p) * v
                db[r] += context_mixing.BIAS_RATE / block * (bit[i] - p)
            w, bias = w + dw, bias + db
        want.append(cost)
        at += m
    assert np.allclose(mixer.score(x, bit, kind, per), want, rtol=1e-3)


def test_scores_beat_single_words_and_tell_copies(spark):
    """Sentences from a small grammar: the model learns what follows what; a text that occurs twice costs little."""
    rng = random.Random(3)

    def text(n):
        out, w = [], "a"
        for _ in range(n):
            w = f"{rng.choice('bcdf')}{'aeiou'[len(out) % 5]}{rng.randrange(6)}" if rng.random() < 0.3 else w[::-1] + "n"[: len(w) < 5]
            out.append(w)
        return " ".join(out)

    rows = [(i, text(80)) for i in range(300)]
    rows += [(1000 + i, words_of(random.Random(i // 2), 60, 10**6)) for i in range(40)]
    rows += [(2000 + i, words_of(random.Random(5000 + i), 60, 10**6)) for i in range(40)]
    got = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    both = [r.bits_per_byte for r in got if 1000 <= r.doc_id < 2000 and all(zlib.crc32(str(x).encode()) % 10 for x in (r.doc_id, r.doc_id ^ 1))]
    once = [r.bits_per_byte for r in got if r.doc_id >= 2000]
    assert max(both) < 0.5 * min(once)


@pytest.mark.parametrize("n", [1, 232, 258, 1300])
def test_end_tokens_are_counted(spark, n):
    """Any number of documents in one partition."""
    rows = [(i, f"w{i % 7} x y") for i in range(n)]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    got = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    total = 4 * len(train)
    count = collections.Counter(f"w{i % 7}" for i in train) + collections.Counter({w: len(train) for w in "xye"})
    for r in got:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in (f"w{r.doc_id % 7}", "x", "y", "e"))
        assert r.train_tokens == total and abs(r.base_score - base) < 1e-9


def test_decisions_make_a_distribution():
    """The probabilities of all bytes after a context sum to one, as every byte is one path of the tree."""
    code = context_mixing.Code(np.arange(256))
    assert abs(sum(0.5**n for n in code.length.tolist()) - 1) < 1e-12
    n, node, bit = code.spread(np.arange(256, dtype=np.uint8))
    assert len({tuple(zip(a.tolist(), b.tolist())) for a, b in zip(np.split(node, np.cumsum(n)[:-1]), np.split(bit, np.cumsum(n)[:-1]))}) == 256


def test_edited_passage_whose_seeds_have_other_first_holders(spark):
    """Edited passages of which earlier documents hold pieces of 20 words: the holder of the whole one is found, with
    few holders of each piece and with many."""
    for copies in (1, 30):
        rng, rows = random.Random(47), []
        for i in range(10):
            p = words_of(rng, 100, 10**6).split()
            q = list(p)
            for k in range(7, 100, 14):
                q[k] = f"edit{i}x{k}"
            pieces = [" ".join(p[k : k + 20]) for k in range(0, 100, 10)] * copies
            rows += [(10_000 * i + k, f"{words_of(rng, 30, 10**6)} {x} {words_of(rng, 30, 10**6)}") for k, x in enumerate(pieces)]
            rows += [(10_000 * i + 9000, f"{words_of(rng, 30, 10**6)} {' '.join(p)}"), (10_000 * i + 9001, f"{' '.join(q)} {words_of(rng, 30, 10**6)}")]
        got = {(r.doc_id, r.other_id): r.n_words for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
        assert all(got.get((10_000 * i + 9001, 10_000 * i + 9000), 0) >= 85 for i in range(10)), copies
