"""Near-duplicate vectors by cross-polytope hashing with fast Hadamard rotations, multiprobe and verification.

A vector is rotated three times by random signs and the Hadamard transform; the axis nearest to it, with
its sign, is one hash.  ``hashes`` of them name a bucket of a table; a vector also enters the buckets got by
exchanging the least certain hash for its runner-up.  Vectors that meet in any bucket are compared, each pair
in the first bucket that it shares only, so links can be counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.llm.components import components
from phaselens.llm.runtime import concluded, settle

#: Rows of a bucket that one task compares with as many others; larger buckets are cut into such blocks.
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of 2."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(len(x), n) / np.sqrt(n)


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """64-bit bucket names of unit rows, tables * probes each."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    random = np.random.default_rng([seed, d])
    out = np.empty((len(x), tables * probes), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        picks, seconds, doubts = [], [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * random.choice([-1.0, 1.0], d))
            size = np.abs(y)
            first = size.argmax(1)
            top = size[rows, first]
            size[rows, first] = -1
            second = size.argmax(1)
            doubts.append(top - size[rows, second])
            picks.append(2 * first + (y[rows, first] < 0))
            seconds.append(2 * second + (y[rows, second] < 0))
        picks, seconds = np.stack(picks, 1), np.stack(seconds, 1)
        order = np.argsort(np.stack(doubts, 1), 1, kind="stable")
        for p in range(probes):
            own = picks.copy()
            if p:
                at = order[:, (p - 1) % hashes]
                own[rows, at] = seconds[rows, at]
            key = np.full(len(x), 1_000_003 * (t + 1) + x.shape[1], np.uint64)
            for k in range(hashes):
                key = (key ^ own[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, t * probes + p] = key.view(np.int64)
    return out


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    """A matrix from lists of ``d`` doubles each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, tables: int = 10, hashes: int = 3, probes: int = 2, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; only vectors of
    equal length are compared.  Equal vectors are one class: each counts the others of its class and all members of
    the classes linked with it.  Rows that repeat count as further vectors.  Rows with a null vec_id are kept, link
    with nothing and have a null component.  Further columns are ignored.
    """
    return concluded(lambda: _near(df, vec_id, vector, cosine, tables, hashes, probes, seed))


def _near(df: DataFrame, vec_id: str, vector: str, cosine: float, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    v = F.col("_v")
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    all_rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")).withColumn("_ok", usable)
    classes = settle(all_rows.where("_ok").groupBy("_v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("d", F.size("_v")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == d))
                x = rows_of(part.column("_v"), d)
                x = x / np.abs(x).max(1, keepdims=True)
                k = bucket_keys(x / np.sqrt((x * x).sum(1, keepdims=True)), tables, hashes, probes, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32)), pa.array(k.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), lists], names=["rep", "keys"])

    named = settle(classes.select("rep", "d", "_v").mapInArrow(keys, "rep long, keys array<long>"))
    entries = named.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    full = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    met = entries.join(full, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("own", block)
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "rep", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    facts = classes.join(named, "rep").select("rep", "n", "d", "_v", "keys")

    def compare(group: pa.Table) -> pa.Table:
        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        own = group.column("own").to_numpy()
        if i != j and len(np.unique(own)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        group = group.take(pa.array(np.lexsort((group.column("rep").to_numpy(), own))))
        own, rep, n = (group.column(c).to_numpy() for c in ("own", "rep", "n"))
        d = group.column("d")[0].as_py()
        x = rows_of(group.column("_v").combine_chunks(), d)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        half = int((own == i).sum()) if i != j else len(own)
        names = np.stack([np.asarray(k) for k in group.column("keys").to_pylist()])
        rows, cols = (np.arange(half), np.arange(half, len(own))) if i != j else (np.arange(len(own)),) * 2
        p, q = np.nonzero(x[rows] @ x[cols].T >= cosine)
        p, q = rows[p], cols[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        # a pair counts in the first bucket, in the order of the left one's list, that both are in
        keep = np.zeros(len(p), bool)
        for at in range(0, len(p), 20_000):
            a, b = names[p[at : at + 20_000]], names[q[at : at + 20_000]]
            shared = (a[:, :, None] == b[:, None, :]).any(2)
            keep[at : at + 20_000] = np.where(shared, a, np.iinfo(np.int64).max).min(1) == key
        p, q = p[keep], q[keep]
        count = np.zeros(len(own), np.int64)
        np.add.at(count, p, n[q])
        np.add.at(count, q, n[p])
        # edges of a forest are enough for components; a loop carries a vector's links
        root = list(range(len(own)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        edges = []
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                edges.append((a, b))
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        has = np.flatnonzero(count)
        return pa.table({"a": np.concatenate([rep[a], rep[has]]), "b": np.concatenate([rep[b], rep[has]]), "links": np.concatenate([np.zeros(len(a), np.int64), count[has]])})

    found = settle(dealt.join(facts, "rep").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, links long"))
    linked = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b")).select(F.col("node").alias("rep"), F.col("component"))
    told = classes.join(linked, "rep", "left").join(roots, "rep", "left").select(
        F.col("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    return (
        all_rows.withColumn("_v", F.when(F.col("_ok"), v)).join(told, "_v", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
