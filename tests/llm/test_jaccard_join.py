import random
import re

import pytest

from phaselens.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, token string, rep long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sets(rows, size):
    out = []
    for d, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        out.append((d, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    return out


def brute(rows, size, percent):
    own = sets(rows, size)
    root = list(range(len(own)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (d, a) in enumerate(own):
        for j in range(i):
            b = own[j][1]
            if a and b and d is not None and own[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(own):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least[find(i)] if d is not None else None)) for i, (d, s) in enumerate(own))


def corpus(seed, near=60, other=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    base = [r.choice(words) for _ in range(130)]
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE\ttwo"), (7, "one two three"), (None, "one two three"), (None, None)]
    for _ in range(near):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((len(rows) * 3, " ".join(w)))
    for _ in range(other):
        w = [r.choice(words) for _ in range(r.randint(3, 300))]
        if r.random() < 0.5:
            at = r.randrange(len(w))
            w[at:at] = passage
        rows.append((len(rows) * 3, " ".join(w)))
    rows += rows[12:16]
    r.shuffle(rows)
    return [(*row, "x", 1) for row in rows]


def answer(found):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found.collect())


@pytest.mark.parametrize("size, percent, short, block", [(3, 90, 64, 192), (3, 90, 3, 7), (5, 80, 4, 16), (1, 50, 5, 11)])
def test_against_brute_force(spark, monkeypatch, size, percent, short, block):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(size + percent)
    df = spark.createDataFrame(rows, SCHEMA)
    assert answer(jaccard_join.jaccard_components(df, size, percent)) == brute(rows, size, percent)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.jaccard_components(df).count() == 0
    assert jaccard_join.keep_one(df).count() == 0


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e f g h i j", "x", 1), (2, "A b c d e f g h i j", "y", 2), (3, "k l m n o p", "z", 3), (None, "a b c d e f g h i j", "n", 4)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "token", "rep"]
    assert sorted(r["rep"] for r in kept.collect()) == [1, 3, 4]


def test_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [(1, long, "", 0), (2, long + " end", "", 0), (3, "x" * 3_000_000, "", 0)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert answer(found) == [("1", 199_998, "1"), ("2", 199_999, "1"), ("3", 1, "3")]


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_one_structure_have_their_own_hashes():
    import numpy as np

    texts = [thue_morse(n, letters).encode() for n in (8, 16, 32, 63, 64, 65, 512, 1024, 4096) for letters in ("ab", "ba")]
    texts += [b"a" * n for n in range(1, 80)] + [b"\x00" * n for n in range(1, 20)] + [b"abcdefgh" + b"\x00" * n for n in range(1, 9)]
    for size in (1, 3):
        h, starts = jaccard_join.shingles(texts, size)
        assert len(h) == len(texts) == len(np.unique(h)) and starts.tolist() == list(range(len(texts) + 1))
    alone = [jaccard_join.shingles([t], 1)[0][0] for t in texts]
    assert alone == jaccard_join.shingles(texts, 1)[0].tolist()


def test_texts_of_one_structured_word_each_are_not_linked(spark):
    rows = [(1, thue_morse(1024, "ab")), (2, thue_morse(1024, "ba")), (3, thue_morse(1024, "AB"))]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 2, 3: 1}


def test_long_chains_of_links(spark):
    words = [f"w{i}" for i in range(700)]
    rows = [(1000 - k, " ".join(words[3 * k : 3 * k + 130])) for k in range(150)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found.collect()) == brute(rows, 3, 90)


def test_frequent_passages_of_unlike_texts_make_no_pairs(spark, monkeypatch):
    r = random.Random(8)
    common = [" ".join(f"c{k}x{i}" for i in range(12)) for k in range(5)]
    rows = [(d, " ".join([*(f"u{d}x{i}" for i in range(60)), *common])) for d in range(400)]
    asked = []
    old = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges, *a: (asked.append(edges.count()), old(edges, *a))[1])
    found = jaccard_join.jaccard_components(spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string"))
    assert all(x["doc_id"] == x["component_id"] for x in found.collect()) and asked == [0, 0]
