"""The class-based language model against plain Python, as a distribution, and on held-out texts."""

import hashlib
import math
import random
import re
import tracemalloc
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from phaselens.llm import class_lm, runtime

SCHEMA = "doc_id long, text string, n long, words string, held boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", True) for i, t in rows], SCHEMA)


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(seed, texts=400, names=60):
    """Sentences of determiner, noun and verb, so that classes tell more than single words; some words are rare."""
    r = random.Random(seed)
    rows = []
    for i in range(texts):
        words = []
        for _ in range(r.randint(1, 12)):
            words += [r.choice(["the", "a", "Every"]), f"noun{min(r.randrange(names), r.randrange(names))}", r.choice(["sees", "likes", "verb%d" % r.randrange(30)])]
        rows.append((i, " ".join(words)))
    return rows


END = "\n"


def named(token):
    """As what a chunk knows a token."""
    if token is None:
        return END
    return END + hashlib.sha256(token.encode()).hexdigest() if len(token.encode()) > class_lm.LONG else token


ODD = [(1000, None), (1001, ""), (1002, " \t\n\x0b "), (None, "the noun1 sees"), (None, None), (5, "the noun1 sees"), (5, "the noun1 sees"), (1003, "Äpfel   a b \x01END \x1c"), (1004, "w" * 5000 + " " + "the noun2 likes " * 3000)]


@pytest.mark.parametrize("chunk", [16_000_000, 3000])
def test_counts_and_base_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(class_lm, "CHUNK", chunk)
    rows = corpus(1, 60) + ODD
    random.Random(3).shuffle(rows)
    found = class_lm.class_scores(frame(spark, rows).repartition(3), class_lm.held_out(), frequent=16).collect()
    count = Counter(t for i, x in rows if not is_held(i) for t in tokens_of(x))
    n, v = sum(count.values()), len(count)
    expected = sorted((repr(i), is_held(i), len(tokens_of(x)), sum(count[t] > 0 for t in tokens_of(x)), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens_of(x)), 6)) for i, x in rows)
    assert expected == sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert all(r["score"] < 0 and abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-9 * r["perplexity"] for r in found)


def learnt(spark, rows, **settings):
    """The model, and class and count of each word, the same in all chunks."""
    model, chunks = class_lm.fit(frame(spark, rows).repartition(3), class_lm.held_out(), **settings)
    known = {}
    for r in chunks.collect():
        own, n = np.frombuffer(r["class"], np.int16), np.frombuffer(r["n"], np.int64)
        tokens, at = np.frombuffer(r["tokens"], "<u4"), 0
        texts = {repr(i): [tokens_of(t) for j, t in rows if repr(j) == repr(i)] for i in r["doc_ids"]}
        for i, end in zip(r["doc_ids"], r["ends"], strict=True):
            words = next(t for t in texts[repr(i)] if len(t) == end - at)
            for w, k in zip(words, tokens[at:end].tolist(), strict=True):
                assert known.setdefault(w, (int(own[k]), int(n[k]))) == (int(own[k]), int(n[k]))
            at = end
    return model, known


@pytest.mark.parametrize("frequent", [12, 100_000])
def test_the_score_is_that_of_the_classes(spark, monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "CHUNK", 4000)
    rows = [(i, t) for i, t in corpus(2, 120)] + [(900, "the noun1 unheard sees"), (901, "unheard of")]
    model, known = learnt(spark, rows, classes=8, frequent=frequent)
    count = Counter(t for i, x in rows if not is_held(i) for t in tokens_of(x))
    assert all(n == count[w] and (c >= 0) == (n > 0) for w, (c, n) in known.items()) and known[None][0] == 0
    assert [w for w, (c, _) in known.items() if c == 0] == [None]
    pairs, once = Counter(), Counter(c for c, n in known.values() if n == 1)
    for i, x in rows:
        if not is_held(i):
            classes = [0, *(known[t][0] for t in tokens_of(x))]
            pairs.update(zip(classes, classes[1:]))
    assert {(a, b): int(model.counts[a, b]) for a, b in np.argwhere(model.counts).tolist()} == dict(pairs) and {c: int(n) for c, n in enumerate(model.once) if n} == dict(once)
    k, total = 8, sum(pairs.values())
    size = [sum(pairs[a, b] for a in range(k)) for b in range(k)]
    rare = [0 if c == 0 else once[c] + 1 for c in range(k)]

    def step(a, b):
        if a == k:  # behind an unknown word
            return sum(rare[c] * step(c, b) for c in range(k)) / sum(rare)
        kinds = max(1, sum((a, c) in pairs for c in range(k)))
        return (pairs[a, b] + kinds * (size[b] + 1) / (total + k)) / (sum(pairs[a, c] for c in range(k)) + kinds)

    def probability(a, w):
        c, n = known.get(w, (-1, 0))
        return step(a, c) * n / (size[c] + rare[c]) if n else sum(step(a, c) * rare[c] / (size[c] + rare[c]) for c in range(k))

    for a in range(k + 1):
        assert abs(sum(probability(a, w) for w in count) + probability(a, "never heard") - 1) < 1e-9
    found = {r["doc_id"]: r["score"] for r in class_lm.class_scores(frame(spark, rows), class_lm.held_out(), classes=8, frequent=frequent).collect()}
    if frequent > 1000:  # the same classes however texts are dealt
        for i, x in rows:
            before, score = 0, 0.0
            for t in tokens_of(x):
                score += math.log10(probability(before, t))
                before = k if not known[t][1] else known[t][0]
            assert abs(score - found[i]) < 1e-6


@pytest.mark.parametrize("frequent", [16, 16_384])
def test_classes_predict_held_out_texts(spark, frequent):
    rows = corpus(5, 1500)
    found = [r for r in class_lm.class_scores(frame(spark, rows), class_lm.held_out(), classes=12, frequent=frequent).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in found)
    base, score = (sum(r[c] for r in found) / tokens for c in ("base_score", "score"))
    assert tokens > 1000 and score > base + 0.3  # half the perplexity


def test_gains_are_differences_of_the_likelihood():
    r = np.random.default_rng(0)
    words, classes = 9, 5
    own = np.array([0, 1, 2, 3, 4, 1, 2, 3, 4])
    text = r.integers(0, words, 400)
    count = lambda own: np.bincount(own[text[:-1]] * classes + own[text[1:]], minlength=classes**2).reshape(classes, classes)
    pair = np.zeros((words, words), np.int64)
    np.add.at(pair, (text[:-1], text[1:]), 1)
    for w in range(1, words):
        others = np.arange(words) != w
        left, right = (np.bincount(own[others], p[others], classes).astype(np.int64) for p in (pair[:, w], pair[w]))
        found = class_lm.gains(count(own), own[w], left, right, int(pair[w, w]))
        moved = [class_lm.likelihood(count(np.where(np.arange(words) == w, b, own))) for b in range(classes)]
        # the ends of the text make the margins differ by one
        assert np.abs((found - found[own[w]]) - (np.array(moved) - moved[own[w]])).max() < 8


def test_without_training_texts(spark):
    held = next(i for i in range(100) if is_held(i))
    (r,) = class_lm.class_scores(frame(spark, [(held, "a b")]), class_lm.held_out()).collect()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and math.isfinite(r["score"])
    assert class_lm.class_scores(frame(spark, []), class_lm.held_out()).collect() == []


def test_a_whole_chunk_takes_few_bytes_for_each_token(monkeypatch):
    """Two workers share an executor's memory with the JVM, so steps over a chunk don't hold it in wide numbers or all at once."""
    monkeypatch.setattr(class_lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    r, names = random.Random(0), [f"w{i}" for i in range(30_000)]
    texts = [" ".join(r.choices(names, k=1000)) for _ in range(2400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(texts[i : i + 100]), pa.array([False] * 100)], names=["doc_id", "text", "held"]) for i in range(0, 2400, 100)]
    sent = types.SimpleNamespace(value=(pa.array(names[:1000]), np.arange(1000) % 63 + 1, 64))
    tracemalloc.start()  # of numpy's arrays; Arrow's aren't counted
    try:
        rows = list(class_lm.encoded(iter(batches)))
        first = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        contexts = sum(b.num_rows for b in class_lm.word_rows(sent)(iter(rows)))
        second = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (len(rows), contexts) == (1, 30_001)
    assert first < 22 * 2400 * 1001 and second < 30 * 2400 * 1001  # 28 and 67 formerly


def test_pieces_give_the_same_rows(monkeypatch):
    monkeypatch.setattr(class_lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rows = [(i, t, i is not None and i % 7 == 2) for i, t in corpus(7, 80) + ODD]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "text", "held"), x, strict=True)) for x in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held", pa.bool_())]))
    model = class_lm.Model(np.arange(25).reshape(5, 5), np.arange(5), 900, 60)
    sent = types.SimpleNamespace(value=(pa.array(["the", "a", "noun1"]), np.array([1, 2, 3]), 5))
    (chunk,) = class_lm.encoded(iter([batch]))
    (row,) = class_lm.rows_of([chunk])
    ends, tokens = row["ends"].values.to_numpy(), np.frombuffer(row["tokens"].as_buffer(), "<u4")
    n = row["n"].values.to_numpy()
    own, found = np.where(n > 0, np.arange(len(n)) % 5, -1), []
    for piece in (1 << 19, 7):
        monkeypatch.setattr(class_lm, "PIECE", piece)
        pairs = [np.concatenate(x).tolist() for x in zip(*class_lm.bigrams(row), strict=True)]
        contexts = pa.Table.from_batches(class_lm.word_rows(sent)(iter([chunk]))).to_pylist()
        found.append((pairs, contexts, [x.tolist() for x in model.scores(own, n, tokens, ends)]))
    assert found[0] == found[1]
    words, (token, before) = [END, *row["words"].values.to_pylist()[1:]], found[0][0]
    expected = [(END, *map(named, tokens_of(t))) for _, t, held in rows if not held]
    assert [(words[b], words[t]) for b, t in zip(before, token, strict=True)] == [p for x in expected for p in zip(x, x[1:])]
    assert len(found[0][1]) == len(words) and len(found[0][2][0]) == len(rows)


def test_settle_bounds_arrow_batches_by_bytes(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(runtime.BATCH_BYTES)
    rows = spark.createDataFrame([("x" * 100_000,)] * 20, "t string").coalesce(1)
    assert [r["n"] for r in runtime.settle(rows.mapInArrow(count, "n long"), batch=1).collect()] == [1] * 20
    assert spark.conf.get(runtime.BATCH_BYTES) == before
