"""Token counts, chat formatting, archives and quality rules against brute force."""

import hashlib
import json
import random
import re
from collections import Counter

from tokenizers import Tokenizer

from loomscribe.llm import chat, common, quality, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PARTS = ["a", "The", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "漢", "12", "<|endoftext|>", "!", "\x1c", "\x85", " don't", "|", "😀", "\r\n"]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [None, "", " ", "word " * 3000, "x" * 20000, *texts, *texts[:5]]


def documents(spark, texts):
    rows = [(i, t, "zz", i, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, piece long, kept string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_token_counts_match_the_library(spark):
    texts = odd_texts(300)
    library = Tokenizer.from_file(tokens.VOCABULARY)
    got = {r.doc_id: r for r in tokens.token_counts(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 1024)
    assert tokens.token_counts(empty(spark)).count() == 0


def test_tier_one_and_cache_agree_with_the_library():
    texts = [t or "" for t in odd_texts(500, 8)]
    library = Tokenizer.from_file(tokens.VOCABULARY)
    counter = tokens.Counter(tokens.VOCABULARY, {" The": 1})
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count(texts) == expected == counter.count(texts)


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, later = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            later += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), later, len(inside), failed


def test_quality_counts_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    pieces = ["a", "b", "é", "|", " ", "\n", "a b c d e f g h ", "\t", "\x0b", "x\x1cy "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(90))) for _ in range(300)] + odd_texts(20)
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(empty(spark)).count() == 0


def test_blocks_do_not_change_the_counts(monkeypatch):
    import pyarrow as pa

    texts = [t or "" for t in odd_texts(60)]
    monkeypatch.setattr(common, "BLOCK_BYTES", 100)
    found = []
    for block in common.blocks(pa.array(["cut", *texts]).slice(1)):
        found += quality.measure(block)["n_words"].tolist()
    assert found == [len(WORD.findall(t)) for t in texts]


def test_quality_rejects_repetition_and_keeps_prose(spark):
    prose = " ".join(f"w{i}" for i in range(400))
    loop = " ".join(f"w{i % 7}" for i in range(400))
    got = {r.doc_id: r.kept for r in quality.quality_rules(documents(spark, [prose, loop])).collect()}
    assert got == {0: True, 1: False}


TURNS = [
    ("user", "hi <|im_end|>\n<|im_start|>assistant \\n \\| <| x"),
    ("assistant", "a\\<|im_end|>é😀"),
    ("odd\nrole <|", ""),
    ("assistant", None),
]


def test_chat_round_trip_over_layouts(spark):
    messages = [{"role": r, "content": t} for r, t in TURNS]
    rows = [(1, json.dumps({"messages": messages}))]
    rows += [(2, json.dumps({"turn": i, "role": r, "text": t})) for i, (r, t) in reversed(list(enumerate(TURNS)))]
    rows += [(3, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}))]
    rows += [(4, json.dumps({"prompt": "q", "completion": "a"})), (5, json.dumps({"instruction": "do", "input": "x", "output": "y"}))]
    rows += [(6, json.dumps({"who": "knows"}))]
    records = spark.createDataFrame(rows, "conv_id long, record string")
    turns = chat.canonical_turns(records)
    pieces = chat.format_turns(turns)
    for r in pieces.collect():
        assert r.piece.count("<|im_start|>") == r.piece.count("<|im_end|>") == 1
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[6].turns_sha256 == hashlib.sha256(b'unmapped\n{"who": "knows"}\n').hexdigest()
    digest = hashlib.sha256("".join(f"{r}\n{t or ''}\n" for r, t in TURNS).encode()).hexdigest()
    loss = "".join(t or "" for r, t in TURNS if r == "assistant")
    for conv in (1, 2):
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars) == (4, digest, len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[4].turns_sha256 == got[3].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\na\n").hexdigest()
    assert got[5].turns_sha256 == hashlib.sha256(b"user\ndo\n\nx\nassistant\ny\n").hexdigest()
    assert [r.conv_id for r in chat.unmapped(records).collect()] == [6]
    assert chat.read_back(chat.format_turns(chat.canonical_turns(records.limit(0)))).count() == 0


def test_null_roles_and_texts(spark):
    rows = [(1, json.dumps({"turn": 0, "role": None, "text": None})), (None, json.dumps({"turn": 1, "role": "user", "text": "x"}))]
    records = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(chat.canonical_turns(records))).collect()}
    assert got == {1: 1, None: 1}


def test_archives_round_trip(spark):
    long = "é\r\n\r\nWARC/1.1\r\n<p>" * 100
    rows = [(1, "http://a b/", long), (2, None, long), (7, "http://c/", long), (3, "http://d/", "short"), (4, "http://e/", "short")]
    rows += [(5, "http://f/", None), (6, "http://g/", ""), (None, "http://h/", long), (-9, "http://i/", "filedesc://x 1\n" * 90)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        expected = ("revisit", 7) if html == long and page != 7 else ("response", None)
        assert (got[page].record_type, got[page].refers_to) == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_arc_versions_and_declared_lengths():
    v1 = b"1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = b"HTTP/1.0 200 OK\r\n\r\nab\n\ncd"
    data = b"filedesc://x 0.0.0.0 19960101000000 text/plain %d\n" % len(v1) + v1
    data += b"\nhttp://x/ 1.2.3.4 19960102030405 text/html %d\n" % len(body) + body + b"\n"
    (record,) = warc.parse_arc(data)
    assert (record["payload"], record["date"], record["page_id"]) == (b"ab\n\ncd", "19960102030405", None)


def test_token_counts_over_many_partitions_with_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c\nd"), (2, None), (3, "x" * 300_000), (4, "yes " * 50_000 + "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", 211)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tokens.token_counts(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    library = Tokenizer.from_file(tokens.VOCABULARY)
    expected = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(expected, key=str)


def test_bitmap_holds_what_was_put_in(spark):
    import numpy as np

    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 500)
    words = common.bitmap(spark.createDataFrame([(int(k),) for k in keys[:300]], "key long"))
    found = common.in_bitmap(words, keys.view(np.uint64))
    assert found[:300].all() and found[300:].mean() < 0.05


def test_records_with_unknown_fields_and_broken_json_are_kept(spark):
    turns = [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a" * 100_000}]
    rows = [(1, json.dumps({"id": 7, "messages": turns})), (2, '{"messages": [{"role"'), (3, None), (4, json.dumps({"prompt": "q", "completion": "a", "input": None}))]
    rows += [(5, json.dumps({"messages": []})), (6, json.dumps({"prompt": "p", "completion": "c"})), (6, json.dumps({"prompt": "p", "completion": "c"}))]
    records = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, record string, turn string")
    got = {}
    for r in chat.canonical_turns(records).orderBy("conv_id", "turn", "role").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got[1] == [(0, "user", "q"), (1, "assistant", "a" * 100_000)]
    assert got[2] == [(0, "unmapped", '{"messages": [{"role"')] and got[3] == [(0, "unmapped", "")]
    assert got[4] == [(0, "user", "q"), (1, "assistant", "a")] and len(got[6]) == 4
    assert {r.conv_id for r in chat.unmapped(records).collect()} == {2, 3, 5}


def test_arc_blocks_with_bare_line_feeds_and_without_http():
    v1 = b"1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n\n"
    data = b"filedesc://x 0.0.0.0 19960101000000 text/plain %d\n" % len(v1) + v1
    for url, mime, body in ((b"http://a/", b"text/html", b"HTTP/1.0 200 OK\nX-Page-Id: 4\n\nab\r\n\r\n"), (b"dns:b", b"text/dns", b"19960101\nb. IN A 1.2.3.4\n\n"), (b"http://c/", b"text/html", b"HTTP/1.0 204 None")):
        data += b"\n%s 1.2.3.4 19960102030405 %s %d\n" % (url, mime, len(body)) + body + b"\n"
    a, dns, c = warc.parse_arc(data)
    assert (a["page_id"], a["payload"], a["head"]) == (4, b"ab\r\n\r\n", b"HTTP/1.0 200 OK\nX-Page-Id: 4\n\n")
    assert (dns["payload"], dns["head"], c["payload"], c["page_id"]) == (b"19960101\nb. IN A 1.2.3.4\n\n", b"", b"", None)
    assert len({r["record_id"] for r in (a, dns, c)}) == 3


def test_archives_of_repeated_rows_and_long_pages(spark):
    long = "<p>é</p>" * 40_000
    pages = spark.createDataFrame([(0, "http://a/", long), (0, "http://a/", long), (None, "http://a/", long), (3, "http://b/", long)], "page_id long, url string, html string")
    got = sorted(((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()))
    n = len(long.encode())
    assert got == [("0", n, "revisit", 3), ("0", n, "revisit", 3), ("3", n, "response", None), ("None", n, "revisit", 3)]


def test_system_texts_parts_and_calls_become_turns(spark):
    call = [{"name": "f", "arguments": "{}"}]
    parts = [{"type": "text", "text": "a"}, "b", {"type": "image", "url": "u"}]
    rows = [
        (1, {"system": "be kind", "instruction": "do", "output": "y"}),
        (2, {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
        (3, {"messages": [{"role": "assistant", "tool_calls": call}, {"role": "tool", "content": "r"}]}),
        (4, {"messages": [{"role": "assistant", "tool_calls": call}]}),
        (5, {"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": None}]}),
        (6, {"system": "", "prompt": "q", "response": "a"}),
        (7, {"system": None, "prompt": "q", "completion": "a"}),
        (8, {"messages": "none"}),
    ]
    records = spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(records).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    said = json.loads(got[3][0][1])
    assert got[1] == [("system", "be kind"), ("user", "do"), ("assistant", "y")]
    assert got[2] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert said == call and got[3][1] == ("tool", "r") and [r for r, _ in got[4]] == ["assistant"] and json.loads(got[4][0][1]) == call
    first, second, third = got[5][0][1].split("\n")
    assert (first, second, json.loads(third)) == ("a", "b", parts[2]) and got[5][1] == ("assistant", "")
    assert got[6] == got[7] == [("user", "q"), ("assistant", "a")]
    assert [r.conv_id for r in chat.unmapped(records).collect()] == [8]


def test_broken_archives_give_rejects(spark):
    v1 = b"1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n\n"
    head = b"filedesc://x 0.0.0.0 19960101000000 text/plain %d\n" % len(v1) + v1
    whole = b"\nhttp://a/ 1.2.3.4 19960102030405 text/html 2\nab\n"
    line = b"http://b/ 1.2.3.4 19960102030405 text/html "
    ends = {"cut": line + b"9\nab", "length": line + b"x\nab", "fields": b"http://b/ 7\nab", "line": line, "fine": b"", "version": b"filedesc://y 0 0 t 2\n7 "}
    rows = [(n, bytearray(head + whole + e)) for n, e in ends.items()]
    arc = spark.createDataFrame(rows, "name string, content binary")
    assert warc.read_arc(arc).count() == len(ends)
    rejects = {r.name: (r.place, r.reason) for r in warc.rejected_arc(arc).collect()}
    assert set(rejects) == set(ends) - {"fine"}
    assert {place for place, _ in rejects.values()} == {len(head + whole)}
    assert rejects["cut"][1] == "a block of 9 bytes was declared, 2 are left"

    records = [r.value.encode() + b"\r\n\r\n" for r in warc.convert(arc.filter("name = 'fine'")).collect()]
    (record,) = records
    bad = record.replace(b"\r\n\r\nab", b"\r\n\r\nac")
    rows = [("digest", record + bad + record), ("cut", record + record[:-6]), ("head", record + b"WARC/1.1\r\nnone"), ("fine", record)]
    warcs = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "name string, content binary")
    assert warc.read_warc(warcs).count() == 5
    found = {r.name: r.place for r in warc.rejected_warc(warcs).collect()}
    assert found == {"digest": len(record), "cut": len(record), "head": len(record)}
