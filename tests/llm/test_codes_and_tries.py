"""Vector codes and conversation tries against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from phaselens.llm import prefix_trie, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, n string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """vec_id, code, error, label of usable rows, and the codebooks, in Python's whole numbers."""
    import math

    x = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], b) for i, v, b in rows]
    w = len(x[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in x]
    first = sorted((i, v) for i, v, _ in x if i is not None)[:entries]
    books = [[v[p * w : p * w + w] for _, v in first] for p in range(parts)]
    near = lambda y, p: min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for row in cut:
            for p in range(parts):
                held[p, near(row[p], p)[1]].append(row[p])
        for (p, k), ys in held.items():
            books[p][k] = [sum(c) // len(ys) for c in zip(*ys, strict=True)]
    out = []
    for (i, _, b), row in zip(x, cut, strict=True):
        found = [near(row[p], p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), b))
    return out, books


def test_vector_codes(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(c) for c in r.normal(size=24).round(3)], [1, 2, None][i % 3]) for i in range(150)]
    rows += [rows[5], rows[5], (None, rows[9][1], 1), (3, rows[40][1], None), (700, [0.0] * 24, 2), (701, [-3000.0] * 24, 2)]
    odd = [(800, None, 1), (801, [None] + [1.0] * 23, 1), (802, [float("nan")] * 24, 1), (803, [float("inf")] * 24, 2), (804, [1.0] * 16, 1), (805, [], 1), (806, [1e30] * 24, None)]
    both = rows + odd
    random.Random(1).shuffle(both)
    df = spark.createDataFrame([(i, v, b, 7, "x") for i, v, b in both], SCHEMA).repartition(5)
    expected, books = plain_codes(rows)
    totals = defaultdict(int)
    for _, _, e, b in expected:
        totals[b] += e
    sha = hashlib.sha256(",".join(str(c) for p in books for k in p for c in k).encode()).hexdigest()
    told = [(i, c, e, totals[b], sha) for i, c, e, b in expected] + [(i, None, None, totals[b], sha) for i, b in ((804, 1), (805, 1), (806, None))]
    assert sorted(map(repr, told)) == sorted(repr(tuple(x)) for x in vector_codes.code_digest(df).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, 1, 1, "")], [(None, [1.0] * 8, 1, 1, "")], [(5, [1.0] * 7, 1, 1, "")], [(5, [1.0] * 8, None, 1, ""), (4, [2.0] * 8, None, 1, "")]])
def test_vector_codes_of_few_rows(spark, rows):
    found = vector_codes.code_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == sum(v is not None for _, v, *_ in rows)
    if len(rows) == 2:
        assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found} == {(4, "00" * 8, 0, 0), (5, "01" * 8, 0, 0)}


def test_distances_are_exact_at_the_limit():
    most = vector_codes.limit(8) - 1
    x, books = np.full((1, 1, 8), most), np.array([[[-most] * 8, [1 - most] * 8, [1 - most] * 8]])
    entry, distance = vector_codes.nearest(x, books)
    assert entry[0, 0] == 1 and int(distance[0, 0]) == 8 * (2 * most - 1) ** 2


def plain_trie(rows, by=5, most=9):
    """Nodes by their prefixes as tuples; every node goes to each of its ancestors."""
    own = defaultdict(list)
    for c, t, a, b in rows:
        if c is not None:
            a, b = a or "", b or ""
            key = hashlib.sha256(f"{len(a.encode())}:{a}{b}".encode()).digest()
            own[c].append((t is not None, t if t is not None else 0, key, a, b))
    turns = {c: [(a, b) for *_, a, b in sorted(x)] for c, x in own.items()}
    made = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        made[c] = tuple(turns.get(c - c % by, [])[:h] + x[h:])
    members = defaultdict(set)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[x[:d]].add(c)
    leaf = {k for k in members if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in members)}
    out = []
    for k, m in members.items():
        below = [j for j in members if j[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        out.append((
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(j) == len(k) + 1 for j in below), sum(j in leaf for j in below),
            sum((len(members[j]) - 1) * len(j[-1][1].encode()) for j in below if j), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, digest string, place int"


@pytest.mark.parametrize("piece", [65_536, 3])
def test_conversation_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "bot", None, ""]), r.choice(["a", "é", "", None, "long " * 2000])) for c in range(120) if c % 7 for t in range(r.randint(1, 12))]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(6)]  # copies
    rows += [(301, None, "user", "x"), (301, None, "bot", "y"), (301, 2, "bot", "z"), (301, 2, "bot", "z"), (None, 1, "user", "nobody"), (302, None, None, None)]
    rows += [(7001, t, "user", str(t % 3)) for t in range(300)]
    r.shuffle(rows)
    found = prefix_trie.conversation_trie(spark.createDataFrame([(*x, 1, "d", 2) for x in rows], CONVERSATIONS).repartition(6))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(repr, plain_trie(rows))) == sorted(repr(tuple(x)) for x in found.select(columns).collect())


def test_conversation_trie_without_turns(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    # 6 takes its first turns from 5, which isn't there, and has no more than it leaves
    assert zlib.crc32(b"6") % 9 >= 1
    (root,) = prefix_trie.conversation_trie(spark.createDataFrame([(6, 0, "user", "gone", 1, "", 1)], CONVERSATIONS)).collect()
    assert (root["conv_id"], root["depth"], root["parent_conv_id"], root["n_leaves"], root["ends_sha256"]) == (6, 0, None, 1, hashlib.sha256(b"6").hexdigest())


def test_the_trie_of_turns_as_they_are(spark):
    rows = [(1, 0, "u", "hello"), (1, 1, "b", "hi"), (2, 0, "u", "hello"), (2, 1, "b", "ho")]
    turns = prefix_trie.turn_digests(spark.createDataFrame([(*x, 1, "", 1) for x in rows], CONVERSATIONS))
    found = {(r["depth"], r["conv_id"]): r for r in prefix_trie.prefix_trie(turns).collect()}
    assert set(found) == {(0, 1), (1, 1), (2, 1), (2, 2)}
    assert (found[1, 1]["n_convs"], found[1, 1]["n_children"], found[1, 1]["saved_tokens"], found[0, 1]["saved_tokens"], found[0, 1]["n_leaves"]) == (2, 2, 5, 5, 2)
    assert found[2, 2]["parent"] == found[1, 1]["digest"]
