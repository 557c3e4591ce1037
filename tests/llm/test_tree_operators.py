"""Embedding near-duplicates, conversation repair and the prefix tree against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomscribe.llm import prefixes, repair, smallworld

VECTORS = "vec_id long, embedding array<float>, n_links string, lead_id string"


def brute_links(rows, least=0.9):
    ids = {}
    for vec_id, vector, *_ in rows:
        fine = vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        if vec_id is not None:
            vector = tuple(np.float32(x) for x in vector) if fine else None
            ids[vec_id] = min((v for v in (ids.get(vec_id), vector) if v is not None), default=None)
    links = {i: set() for i in ids}
    for a, x in ids.items():
        for b, y in ids.items():
            if a != b and x and y and len(x) == len(y):
                u, v = np.array(x, float), np.array(y, float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                    links[a].add(b)
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(links[i]), min(seen), i == min(seen)))
    return sorted(out)


def clustered(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[n // 3 : n // 2] = base[0] + rng.normal(size=(n // 2 - n // 3, dim)) * 0.1
    base[n // 2 : n // 2 + 40] = base[1]
    for i in range(n // 2 + 40, n // 2 + 80):
        base[i] = base[i - 60] * 3 + rng.normal(size=dim) * 0.02
    return base.astype(np.float32)


@pytest.mark.parametrize("shard_rows", [300, 1000])
def test_near_duplicate_vectors_match_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(smallworld, "SHARD_ROWS", shard_rows)
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(clustered(900))]
    rows += [(2000, None, "", ""), (2001, [], "", ""), (2002, [0.0] * 16, "", ""), (2003, [float("nan")] * 16, "", ""), (2004, [None] * 16, "", "")]
    rows += [(2005, [1.0, 2.0], "", ""), (2006, [2.0, 4.0], "", ""), (None, rows[0][1], "", ""), rows[5], (7, rows[3][1], "", "")]
    got = smallworld.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows)


def test_near_duplicate_vectors_of_an_empty_table(spark):
    assert smallworld.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_audit_widens_the_beam_until_links_are_found(monkeypatch):
    x = clustered(1200).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = smallworld.Graph(x)
    graph.layers[0].links[:] = -1  # a graph that leads nowhere: only the widest beam, the scan, passes the audit
    ones = np.ones(len(x), int)
    counts, lead, linked = smallworld.links_between(graph, ones, x, ones, True, 0.9)
    truth = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert (counts == truth).all() and (linked == (truth > 0)).all()
    assert (lead[linked] <= np.flatnonzero(linked)).all()


def brute_repair(rows):
    """Least (cost, letters) over all edits, by dynamic programming over rows, the state and few insertions."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserted(states):
        for _ in range(2):
            new = dict(states)
            for state, (cost, letters, out) in states.items():
                for role in follow[state].replace("s", ""):
                    offer = (cost + 2, letters + "I", (*out, ({"u": "user", "a": "assistant"}[role], "")))
                    new[role] = min(new.get(role, offer), offer)
            states = new
        return states

    for (_, role, text), flaw in zip(rows, faults):
        new = {}
        for state, (cost, letters, out) in inserted(best).items():
            offers = [(state, (cost + 3, letters + "D", out))]
            if flaw not in ("blank", "duplicate"):
                extra = flaw == "truncated"
                if role[:1] and role[:1] in follow[state]:
                    offers.append((role[0], (cost + extra, letters + "K", (*out, (role, text)))))
                for to in follow[state].replace("s", ""):
                    offers.append((to, (cost + 2 + extra, letters + "R", (*out, ({"u": "user", "a": "assistant"}[to], text)))))
            for to, offer in offers:
                new[to] = min(new.get(to, offer), offer)
        best = new
    cost, letters, out = min(v for k, v in inserted(best).items() if k in ("", "a"))
    first = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * ((fate != 0) + (fate == 3))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def odd_conversations():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", "sage", None], ["Yes.", "No", " ", "", "Long one!\n", "x? ", None, "a.b", "É."]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}."))
    rows += [(500, t, "assistant" if t % 3 else "user", "same." if t % 7 == 0 else f"turn {t}" + "." * (t % 4 > 0)) for t in range(700)]
    rows += [(501, 1, "user", "word " * 500_000), *[(502, 3, "user", "again.")] * 4]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, pos string, edit string"


def test_repair_matches_brute_force(spark):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "p", "e") for r in rows], CONVERSATIONS).repartition(5)
    got = {r["conv_id"]: r for r in repair.repair_report(table).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        left = damaged([r for r in rows if r[0] == conv])
        want = brute_repair(left) if left else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(got[conv][c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) == want, conv


def test_repaired_rows_are_a_conversation(spark):
    table = spark.createDataFrame([(*r, "p", "e") for r in odd_conversations()], CONVERSATIONS)
    kept = {}
    for r in sorted(repair.repair(table).filter("edit <> 'D'").collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["pos"])):
        kept.setdefault(r["conv_id"], []).append(r["role"][0])
    assert kept and all(re.fullmatch("s?(ua)+", "".join(k)) for k in kept.values())


def test_repair_of_an_empty_table(spark):
    assert repair.repair_report(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_auction_prices_are_exact_from_every_state():
    rng = random.Random(1)
    for _ in range(100):
        lattice = [repair.arcs(rng.choice("suat-"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randint(1, 12))]
        price, exact = repair.auction(lattice, repair.ENDS), [list(repair.ENDS)]
        for row in reversed(lattice):
            now = [10**6] * 4
            for _ in range(4):
                now = [min(cost + (exact[0] if on else now)[to] for _, cost, on, to in row[s]) for s in range(4)]
            exact.insert(0, now)
        assert price[0] == exact[0]
        for at, row in enumerate(lattice):
            assert all(price[at][s] <= cost + price[at + on][to] for s in range(4) for _, cost, on, to in row[s])


def brute_tree(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    gain = {k: (len(v) - 1) * (len(k[-1][1]) if k else 0) for k, v in nodes.items()}
    kids = {k: sum(len(o) == len(k) + 1 and o[: len(k)] == k for o in nodes) for k in nodes}
    out = []
    for k, members in nodes.items():
        below = [o for o in nodes if o[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), kids[k], sum(kids[o] == 0 for o in below), sum(gain[o] for o in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TREE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("short, bits", [(16384, 16), (20, 3)])
def test_prefix_tree_matches_brute_force(spark, monkeypatch, short, bits):
    monkeypatch.setattr(prefixes, "RANGE_BITS", bits)
    monkeypatch.setattr(prefixes, "BLOCK_BITS", bits)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "höre 𝄞", "", None])) for c in [*range(90, 140), 200, 201, 305] for t in [None, *range(rng.randint(0, 6))]]
    rows += [(c, 0, "user", "same start") for c in range(1000, 1060)] + [(None, 1, "user", "x"), (7, 1, "user", "long " * 500_000), (7, 1, "user", "long " * 500_000)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, node string, depth string").repartition(4)
    turns = prefixes.ordered_turns(table)
    got = prefixes.prefix_tree(prefixes.rebuilt_turns(turns), short)
    assert sorted((tuple(r[c] for c in TREE) for r in got.collect()), key=repr) == brute_tree(rows)


def test_prefix_tree_of_an_empty_table(spark):
    assert prefixes.conversation_prefixes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
