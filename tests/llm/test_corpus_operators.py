"""Deduplication, packing, BPE, search, toxicity and the pipeline against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers
import pytest
from loomscribe.llm import bpe, minhash, neighbours, packing, substring, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", "src", 0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component long")


def family_texts(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one two", "One TWO", "a b c d"]
    for _ in range(n // 6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 120, 700]))]
        for edits in (0, 0, 1, 2, len(base) // 25, len(base) // 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def brute_components(texts, k=4):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(spark):
    texts = family_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, texts), k=4).collect()}
    for i, (n, component) in enumerate(brute_components(texts)):
        assert got[i] == (n, component, i == component)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0


def fine_group(texts, k, component=None):
    import pyarrow as pa

    (block,) = minhash.lowered(pa.array(texts))
    key, doc = minhash.shingles(block, k)
    ids, part = np.arange(len(texts)), np.zeros(len(texts), int)
    n = np.bincount(doc, minlength=len(texts))
    group = minhash.Group(ids, ids if component is None else component, n, minhash.fine_registers(key, doc, len(texts)), part, 80)
    return group, np.split(key, np.searchsorted(doc, np.arange(1, len(texts))))


def test_estimates_are_close():
    words = np.random.default_rng(1).integers(0, 10**9, 9000)
    for a, b in (((0, 2000), (200, 2200)), ((0, 8000), (500, 8600))):
        group, (x, y) = fine_group([" ".join(map(str, words[a[0] : a[1]])), " ".join(map(str, words[b[0] : b[1]]))], 1)
        j, estimate = group.judge(0)
        exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert len(j) == 1 and abs(estimate[0] - exact) < 0.05


def test_no_pair_over_the_threshold_is_rejected():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for size in (6, 20, 60, 250, 1000, 3000):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edit in range(14):
            copy = list(base)
            for _ in range(edit * size // 160):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    group, sets = fine_group(texts, 4)
    kept, possible = set(zip(*group.pairs(False))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                possible += 1
                assert (j, i) in kept
    assert possible > 100 and len(kept) < 3 * possible


def test_groups_in_several_cells_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 3)
    texts = family_texts(21, 60) + ["same words here again now"] * 9
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts), k=4).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_components(texts))}


def brute_repeats(texts, k=13):
    first, out = {}, []
    words = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    for i, w in enumerate(words):
        gone = {p for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n)) for n in (12, 13, 30, 80)]
    texts = [None, "", "x " * 40, "x " * 40, "x y " * 20]
    for _ in range(60):
        parts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))) for _ in range(3)]
        texts.append("\n".join(rng.choice(shared) if rng.random() < 0.4 else p for p in parts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    assert substring.deduplicate(documents(spark, ["x"]).limit(0)).count() == 0


def test_substring_dedup_by_many_small_units_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WINDOWS", 9)
    monkeypatch.setattr(substring, "TASK_WORDS", 200)
    monkeypatch.setattr(substring, "PIECE_BITS", 3)
    monkeypatch.setattr(substring, "PIECE", 8)
    rng = random.Random(14)
    hot = " ".join(f"h{i}" for i in range(60))
    texts = [None, " ".join(f"l{rng.randrange(300)}" for _ in range(4000))]
    for i in range(40):
        own = " ".join(f"u{rng.randrange(9)}" for _ in range(rng.randrange(40)))
        texts.append(f"{own} {hot} {own}" if i % 3 else f"{hot}\n\n{own} {texts[1][90 * i : 90 * i + 900]}")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_automata_find_places_that_nothing_told_them():
    words = [f"w{i}".encode() for i in range(30)]
    automaton, number = substring.compiled([(5, words[:20])])
    text = [b"x", *words[3:19], b"y", *words[:12], b"z", *words[7:25]]
    assert substring.occurrences(automaton, number, 9, text) == [1, 2, 3, 4, 31]
    assert substring.occurrences(automaton, number, 5, text) == substring.occurrences(automaton, number, 4, text) == []


def test_substring_dedup_keeps_rows_of_one_id_apart(spark):
    shared, own, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("s", 20), ("o", 60), ("q", 15)))
    lines = [(1, shared), (2, f"{own} {shared}"), (2, f"{own} z"), (2, short), (2, short), (2, None), (None, shared), (3, short)]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicate(docs).collect())
    want = [(1, 20, 0, shared), (2, 80, 20, own), (2, 61, 0, f"{own} z"), (2, 15, 0, short), (2, 15, 0, short), (2, 0, 0, ""), (None, 20, 0, shared), (3, 15, 15, "")]
    assert got == sorted((str(i), *rest) for i, *rest in want)


def test_packing_is_whole_and_tight(spark):
    texts = [None, "", "Hello, WORLD! é <|endoftext|> ΑΣ", *(" ".join(f"word{i}" for i in range(n)) for n in (1, 50, 700, 900, 1200, 3000, 9000)), "x" * 30000]
    library = Tokenizer.from_file(packing.VOCABULARY)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    expected = {(i, k): (a, len(x[a : a + 4096]), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())) for i, x in enumerate(ids) for k, a in enumerate(range(0, len(x), 4096))}
    rows = packing.pack(packing.pieces(documents(spark, texts))).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


def test_best_two_fit_fills_gaps():
    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2000, 3000)
    bins = packing.best_two_fit(sizes, 4096)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sizes[b].sum() for b in bins) <= 4096
    assert len(bins) <= sizes.sum() / 4096 * 1.005 + 1


def test_bpe_matches_the_library_and_decodes(spark):
    rng = random.Random(6)
    parts = ["the", " The", "'s", "\n", "  ", "é", "漢字", "123", "!?", "😀", "\t", "ing", "zzzz", " x"]
    texts = [None, "", "a" * 500, "ab" * 300, *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(60))]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (1080, [None] * 16), (601, rows[0][1]), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(600), 601])
    x = np.array([r[1] for r in rows[:600]] + [rows[0][1]])
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert [f[0] for f in found] == list(range(1, 21))
        hits += len(set(best) & {f[1] for f in found})
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert neighbours.nearest(few, F.col("vec_id") == 0).count() == 4
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_toxicity_finds_held_out_insults(spark):
    rng = random.Random(9)
    bad, plain = [f"insult{i}" for i in range(6)], [f"word{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        toxic.append(int(i % 6 == 0))
        for _ in range(4 * toxic[-1]):
            words[rng.randrange(len(words))] = rng.choice(bad).upper()
        texts.append(" ".join(words))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in range(600) if rows[i].held_out]
    assert all(rows[i].predicted == toxic[i] for i in held) and len(held) > 60
    assert toxicity.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.common.load(spark, sf, "documents")
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.staged(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r.doc_id for r in docs.collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:]))
    assert len(seen[0]) > len(seen[2]) > len(seen[3]) and seen[4] == seen[5]


def test_pipeline_near_duplicate_stage_matches_brute_force(spark):
    import corpus_pipeline

    texts = family_texts(8, 36)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts).drop("component"), "").collect()}
    assert kept == {i for i, (_, c) in enumerate(brute_components(texts, 5)) if c == i}


def test_pipeline_near_duplicate_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (2, b.upper()), (3, c), (3, c), (None, a), (None, a), (None, None), (4, ""), (4, None), (4, " "), (5, f"{b} z")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [(1, a), (2, b), (3, c), (None, a), (None, a), (None, ""), (4, ""), (4, " ")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_cut_stage_matches_brute_force(spark):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents(spark, [f"start {passage} end", f"other {passage} tail", passage, "plain  text"]).drop("component")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {0: f"start {passage} end", 1: "other tail", 3: "plain  text"}


@pytest.mark.parametrize("kind", ["token", "folded", "long"])
def test_bpe_decodes_the_ids(spark, kind):
    ranks = bpe.read_ranks()
    text = {"token": "so the end", "folded": "a qzxv b", "long": "q" * 200}[kind]
    ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    piece_of = {rank: token for token, rank in ranks.items()}
    changed = piece_of | {ids[1 if kind != "long" else 0]: b"\xff?"}
    for pieces in (piece_of, changed):
        row = bpe.encode_documents(documents(spark, [text]), piece_of=pieces).first()
        assert row.decoded_sha256 == hashlib.sha256(b"".join(pieces[i] for i in ids)).hexdigest()


def test_bpe_merges_long_words_like_the_library(spark):
    rng = random.Random(12)
    texts = ["a" * 3000, "".join(rng.choice("abcdeéß漢") for _ in range(100_000)), "x" * 127 + " " + "y" * 129, "the\nThe  the\t"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs).collect()}
    want = set()
    for i, t in [(i // 2, t) for i, t in enumerate(texts)] + [(None, "")]:
        ids = library.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == want
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_bpe_numbers_the_words_of_a_chunk():
    rng = random.Random(21)
    parts = ["the", " The", "'s", "\n", "  ", " ", "é", "漢字", "123", "!?", "\x1c", "\u2003", "\t", " '", "a\u0301", "\n\n"]
    texts = ["", " ", "a", "\n", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(500)), "so it's\nthe end"]
    words, numbers, sizes = bpe.worded(pa.array(texts))
    assert words.to_pylist() == list(dict.fromkeys(words.to_pylist()))
    ends, all_of = [0, *np.cumsum(sizes).tolist()], words.take(pa.array(numbers)).to_pylist()
    assert [all_of[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [bpe._WORD.findall(t) for t in texts]


def test_bpe_takes_one_pass_and_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 40)
    texts = [None, "", "so the end of qzxv", "", "x" * 200 + " the\nend", "of the of the", None]
    docs = documents(spark, texts)
    spark.sparkContext.setJobGroup("bpe plan", "no job may run before the one that returns the rows")
    found = bpe.encode_documents(docs)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("bpe plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    want = {i: hashlib.sha256(",".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_sha256 for r in found.collect()} == want


def test_probing_retrieves_the_radius_and_spares_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20000, 32))
    index = neighbours.Index(codes := neighbours.Codes(x[:4000]), np.arange(len(x)), x)
    code, asked = neighbours.substrings(codes.bits(x)), neighbours.substrings(codes.bits(x[:20], query=True))
    share = []
    for q in asked:
        rows = next(index.probes(q))
        distance = np.bitwise_count(code ^ q).sum(axis=1)
        assert set(np.flatnonzero(distance <= code.shape[1] * (neighbours.PROBE + 1) - 1)) <= set(rows)
        share.append(len(rows) / len(x))
    assert np.mean(share) < 0.4


@pytest.mark.parametrize("spread", [0.0, 0.2])
def test_neighbours_recall_without_widening(spread):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12000, 64))
    x *= np.exp(rng.normal(size=(len(x), 1)) * spread)
    index = neighbours.Index(codes := neighbours.Codes(x[:4000]), np.arange(len(x)), x)
    bits = codes.bits(x[:40], query=True)
    packs, code = neighbours.packed(bits), neighbours.substrings(bits)
    hits, read = 0, 0
    for i in range(40):
        near = x @ x[i]
        near[i] = -np.inf
        hits += len(set(np.argsort(-near)[:20]) & {h[1] for h in index.nearest(i, x[i], packs[i], code[i], 20)})
        rows = next(index.probes(code[i]))
        near_rows = index.near_codes(packs[i], code[i], neighbours.WIDTH * 20)
        read += len(near_rows)
        assert set(near_rows) <= set(rows)
    assert hits / 800 >= 0.9 and read / 40 < 0.3 * len(x)


def test_neighbours_of_vectors_of_extreme_length(spark):
    rows = [(0, [1e-300, 0.0]), (1, [1e150, 1e150]), (2, [5e-324, 0.0]), (3, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in neighbours.nearest(frame, F.col("vec_id") == 3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 0), (3, 2)]


def test_neighbours_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in neighbours.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 3, 1.0), (2, 1, 0.5), (3, 1, 0.5), (4, 2, 0.0)]


def test_packing_of_repeated_and_null_ids_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs)).collect()
    assert sorted(((r.doc_id, r.length) for r in rows), key=str) == [(1, 3), (1, 3), (2, 1), (None, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_toxicity_scores_match_a_plain_sum(spark):
    import math

    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(80)], ["vile", "Foul", "nasty"]
    texts = [" ".join(rng.choice(plain + bad * (8 * (i % 4 == 0))) for _ in range(30)) for i in range(240)] + ["", None, "vile! FOUL-nasty é", "x " * 60_000 + "vile"]
    docs = documents(spark, texts + texts[:3])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)

    def one(word, kind):
        import pyarrow as pa
        from loomscribe.llm import common

        (block,) = common.blocks(pa.array([word]))
        return int(common.mix(block.word_hash() + np.uint64(kind))[0])

    weight = {(int(k), int(i)): w for k, i, w in zip(model.kind, model.item, model.weight)}
    for r in toxicity.score(docs, model).collect():
        text = "".join(c.lower() if c.isascii() else c for c in (texts + texts[:3])[r.doc_id] or "")
        words = set(re.findall(rb"[a-z0-9\x80-\xff]+", text.encode()))
        items = {(k, w[:size] if size else w) for w in words for k, size in enumerate(toxicity.KINDS) if not size or len(w) >= size}
        total = model.bias + sum(weight.get((k, one(w.decode("utf-8", "surrogateescape"), k)), 0.0) for k, w in items if w.isascii())
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9 or any(not w.isascii() for _, w in items)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


STAGE_ROWS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component long"


def test_pipeline_stages_with_odd_rows(spark):
    import corpus_pipeline

    prose = " ".join(f"w{i}" for i in range(60))
    rows = [(1, prose), (1, prose), (None, prose), (2, None), (3, ""), (4, " \n"), (5, "x" * 200_000), (None, None), (6, f"{prose} tail")]
    docs = spark.createDataFrame([(i, t, None, None, None, "clash", 7) for i, t in rows], STAGE_ROWS)
    sf = "/root/testdata/sf0.001"
    key = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert key(stages["toxicity"](spark, docs, sf)) == sorted(rows, key=str)
    assert key(stages["quality_rules"](spark, docs, sf)) == sorted(((i, t) for i, t in rows if t and t.startswith("w0")), key=str)
    want = [(1, prose), (None, prose), (2, None), (3, ""), (4, " \n"), (5, "x" * 200_000), (None, None)]
    assert key(stages["near_duplicates"](spark, docs, sf)) == sorted(want, key=str)
    cut = [(i, t) if i != 6 else (6, "tail") for i, t in rows]
    got = key(stages["substring_dedup"](spark, docs, sf))
    assert got == sorted(((i, t or "") if i in (2, None) and not t else (i, t) for i, t in cut), key=str) or got == sorted(cut, key=str)
    assert stages["best_fit_packing"](spark, docs, sf).select("doc_id").distinct().count() == 7
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs.limit(0), sf)
        assert found.count() == 0
        if name != "best_fit_packing":
            assert found.columns == list(corpus_pipeline.COLUMNS)
