import math
import random

import numpy as np
import pytest

from phaselens.llm import near_embeddings, topk

SCHEMA = "vec_id long, embedding array<float>, n long, rep long"


def vectors(seed, n=400, d=12, near=80):
    r = np.random.default_rng(seed)
    out = r.normal(size=(n, d)).astype(np.float32)
    centre = r.normal(size=d)
    for k in range(near):
        out[k] = centre + r.normal(size=d) * 0.05
    for k in range(near, near + 30):
        out[k] = out[near + 40 + k % 3]
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(out)]


ODD = [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [float("nan")] + [1.0] * 11), (9004, [None] + [1.0] * 11), (9005, [float("inf")] + [1.0] * 11), (9006, [1.0, 2.0]), (9050, [3.0, 6.0]), (None, [1.0] * 12)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("block", [512, 9])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_embeddings, "BLOCK", block)
    rows = vectors(1) + ODD
    random.Random(0).shuffle(rows)
    links = {i: set() for i, _ in rows}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v) and any(v)]
    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    found = {r["vec_id"]: r for r in near_embeddings.near_duplicates(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    total = sum(map(len, links.values()))
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * total
    for i, r in found.items():
        assert r["n_links"] <= len(links[i])
    if sum(r["n_links"] for r in found.values()) == total:
        for i, r in found.items():
            seen, todo = set(), [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += links[k]
            assert r["component_id"] == (min(seen) if i is not None else None)


def test_near_duplicates_of_nothing(spark):
    assert near_embeddings.near_duplicates(frame(spark, [])).count() == 0
    assert near_embeddings.near_duplicates(frame(spark, ODD[:6])).where("n_links > 0 or not kept").count() == 0


@pytest.mark.parametrize("ranges", [8192, 50])
def test_top_k(spark, monkeypatch, ranges):
    monkeypatch.setattr(topk, "RANGE", ranges)
    monkeypatch.setattr(topk, "VISIT", 3)
    rows = vectors(2) + ODD + [(50, [0.5] * 12), (100, [0.5] * 12)]
    data = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            data.setdefault(i, []).append([math.floor(256 * float(np.float32(c))) for c in v])
    want = []
    for q, own in data.items():
        if q % 50 == 0:
            best = {}
            for w in own:
                for i, vs in data.items():
                    for v in vs:
                        if i != q and len(v) == len(w):
                            s = sum(a * b for a, b in zip(v, w, strict=True))
                            best[i] = max(s, best.get(i, s))
            want += [(q, k + 1, i, s) for k, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    found = topk.top_k(frame(spark, rows))
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("ranges", [8192, 20])
def test_top_k_ids_of_many_vectors(spark, monkeypatch, ranges):
    monkeypatch.setattr(topk, "RANGE", ranges)
    r = np.random.default_rng(8)
    rows = [(i, (np.ones(4) * (60 - i) + r.normal(0, 0.1, 4)).tolist()) for i in range(51) for _ in range(9)]
    x = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in rows]
    want = []
    for q in (0, 50):
        best = {}
        for _, w in (y for y in x if y[0] == q):
            for i, v in x:
                if i != q:
                    best[i] = max(int(w @ v), best.get(i, -(10**12)))
        want += [(q, k + 1, i, s) for k, (i, s) in enumerate(sorted(best.items(), key=lambda b: (-b[1], b[0]))[:5])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows)).collect())) == sorted(want)


def test_top_k_of_nothing(spark):
    assert topk.top_k(frame(spark, [])).count() == 0


def test_blocks_are_skipped():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 5, (640, 8)) for c in (-200, 0, 200)]).astype(np.int64)
    blocks = topk.Blocks(np.arange(len(x)), x)
    scored = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal scored
            scored += isinstance(at, slice)
            return super().__getitem__(at)

    blocks.ids = blocks.ids.view(Counted)
    blocks.search(0, x[1900], 5, None)
    assert scored < len(blocks.starts) / 2


@pytest.mark.parametrize(("d", "least"), [(64, 0.99), (256, 0.98), (768, 0.95)])
def test_recall_of_pairs_at_the_threshold_by_dimension(d, least):
    r = np.random.default_rng(d)
    x = r.normal(size=(1500, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = r.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    a, b = (near_embeddings.bucket_keys(v, 10, 3, 2, 7) for v in (x, y))
    met = (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()
    assert met >= least, met
