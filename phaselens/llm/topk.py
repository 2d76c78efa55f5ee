"""Exact top-k by inner product with block-at-a-time pruning.

Each dimension is two terms, one for either sign of the query's weight; a document's value for the second is
its negated component.  Documents are dealt into ranges of similar ones, and these into blocks with the
maximum of each term.  A block's bound for a query is the sum of its term maxima by the query's weights.
A range's blocks are scored through their forward indexes (the documents' whole vectors) from the highest bound
down, until the bound falls below the query's k-th score so far.  Queries first search the range they lie in;
what they find there is the threshold that they bring to the others.  Bounds of whole ranges, from their term maxima alone,
say which of those a query must visit; only there go its vector and the range's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaselens.llm.runtime import concluded, settle

#: Documents of a block, documents of a range on average, queries that visit a range together.
BLOCK, RANGE, VISIT = 64, 8192, 4096
#: Ranges whose bounds are looked at together.
SPAN = 256
#: Random directions that name a range; similar vectors get similar names, so blocks have tight maxima.
SIGNS = 16


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, x (array of long, floor(scale * component)); rows with nulls or non-finite components are left out."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)).alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A matrix of longs from lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.int64, copy=False)


class Blocks:
    """The documents of one range as blocks with term maxima and forward indexes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        # order by leading signs, so that a block holds neighbours
        random = np.random.default_rng(5).normal(size=(x.shape[1], SIGNS))
        order = np.lexsort((ids, (((x @ random) > 0) @ (1 << np.arange(SIGNS))))) if x.shape[1] else np.argsort(ids)
        self.ids, self.x = ids[order], x[order].astype(np.float64)
        self.starts = np.arange(0, len(ids), BLOCK)
        self.most = np.maximum.reduceat(self.x, self.starts, axis=0)
        self.least = np.minimum.reduceat(self.x, self.starts, axis=0)
        #: Sums of products stay exact in doubles below 2 ** 53.
        self.exact = float(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**52
        self.long = None if self.exact else x[order]

    def search(self, query: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """Up to k (score, vec_id) with a score of ``least`` or more, best first and each vec_id once; ties to the smaller vec_id; without the query's own rows."""
        w = q.astype(np.float64)
        up, down = np.maximum(w, 0), np.minimum(w, 0)
        bound = self.most @ up + self.least @ down
        if not self.exact:
            bound = bound * (1 + 1e-9 * np.sign(bound)) + 1
        found: list[tuple[int, int]] = []  # (-score, vec_id)
        for b in np.argsort(-bound, kind="stable").tolist():
            floor = -found[k - 1][0] if len(found) >= k else None
            floor = least if floor is None else floor if least is None else max(floor, least)
            if floor is not None and bound[b] < floor:
                break
            at = slice(self.starts[b], self.starts[b] + BLOCK)
            score = self.x[at] @ w if self.exact else self.long[at] @ q
            ids = self.ids[at]
            ok = ids != query if floor is None else (ids != query) & (score >= floor)
            if ok.any():
                best = {}
                for s, i in sorted([*found, *zip((-score[ok]).astype(np.int64).tolist(), ids[ok].tolist(), strict=True)]):
                    best.setdefault(i, s)
                    if len(best) == k:
                        break
                found = [(s, i) for i, s in best.items()]
        return [(-s, i) for s, i in found]


FOUND = "query_id long, vec_id long, score long"


def answers(rows: list[tuple[int, int, int]]) -> pa.Table:
    q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})


def top_k(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query among all other vec_ids.

    Queries are the rows whose vec_id is divisible by ``every``.  Ties go to the smaller vec_id; fewer candidates give
    fewer rows.  Vectors that are null or hold null or non-finite components take no part; only vectors of the same
    length meet.  A row that repeats is one candidate and one query; of rows that share a vec_id with different vectors
    each is a query and a candidate, and the best scores of both count once.  Further columns are ignored.
    """
    return concluded(lambda: _top(df, k, every, vec_id, vector, scale))


def _top(df: DataFrame, k: int, every: int, vec_id: str, vector: str, scale: int) -> DataFrame:
    docs = quantised(df, vec_id, vector, scale).distinct().withColumn("d", F.size("x"))
    docs = settle(docs)
    ranges = docs.agg(F.count("*")).first()[0] // RANGE + 1
    # neighbours share a range name: leading signs of sums over a fixed pattern of components
    docs = docs.withColumn("_h", F.pmod(F.xxhash64(F.transform(F.slice("x", 1, 4), lambda c: F.signum(c.cast("double")))), F.lit(16)))
    # each of the 16 kinds has its share of the ranges, so a kind that all rows share makes none much larger
    share = -(-ranges // 16)
    docs = docs.withColumn("home", F.pmod(F.col("_h") * share + F.pmod(F.xxhash64("vec_id"), F.lit(share)), F.lit(ranges))).drop("_h")
    docs = settle(docs)

    def first(group: pa.Table) -> pa.Table:
        ids, x = group.column("vec_id").to_numpy(), matrix(group.column("x"), group.num_rows)
        blocks, out = Blocks(ids, x), []
        for row in np.flatnonzero(ids % every == 0).tolist():
            out += [(int(ids[row]), v, s) for s, v in blocks.search(int(ids[row]), x[row], k, None)]
        found = answers(out)
        ends = [pa.array([None] * found.num_rows + [e.tolist()], pa.list_(pa.int64())) for e in (x.max(0), x.min(0))]
        place = [pa.array([None] * found.num_rows + [group.column(c)[0].as_py()], kind) for c, kind in (("d", pa.int32()), ("home", pa.int64()))]
        columns = [pa.concat_arrays([*found.column(c).chunks, pa.nulls(1, pa.int64())]) for c in found.column_names]
        return pa.Table.from_arrays([*columns, *place, *ends], names=[*found.column_names, "d", "home", "most", "fewest"])

    # what queries find at home, and a row for each range with its term maxima and minima
    both = settle(docs.groupBy("d", "home").applyInArrow(first, FOUND + ", d int, home long, most array<long>, fewest array<long>"))
    near = both.where("query_id is not null").select("query_id", "vec_id", "score")
    ranged = both.where("query_id is null").select("d", "home", "most", "fewest")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query_id", F.col("score").alias("least"))
    asked = docs.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").join(least, "query_id", "left")
    asked = settle(asked)
    parties = asked.count() // VISIT + 1
    party = F.pmod(F.xxhash64("query_id"), F.lit(parties))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumn("party", party)

    def may(queries: pa.Table, ranges_: pa.Table) -> pa.Table:
        """Pairs of a query and a range whose bound reaches the query's threshold."""
        if not queries.num_rows or not ranges_.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        w = matrix(queries.column("x"), queries.num_rows).astype(np.float64)
        most, fewest = (matrix(ranges_.column(c), ranges_.num_rows).astype(np.float64) for c in ("most", "fewest"))
        bound = np.maximum(w, 0) @ most.T + np.minimum(w, 0) @ fewest.T
        bound += np.abs(bound) * 1e-9 + 1  # more than sums of doubles can be wrong by
        least = np.array([-np.inf if v is None else v for v in queries.column("least").to_pylist()], np.float64)
        home, to = queries.column("home").to_numpy(), ranges_.column("home").to_numpy()
        q, r = np.nonzero((bound >= least[:, None]) & (home[:, None] != to[None]))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "to": pa.array(to[r])})

    spans = -(-ranges // SPAN)
    looking = asked.withColumn("span", upto(spans)).groupBy("d", "party", "span")
    looked_at = ranged.withColumn("span", F.floor(F.col("home") / SPAN)).withColumn("party", upto(parties)).groupBy("d", "party", "span")
    pairs = settle(looking.cogroup(looked_at).applyInArrow(may, "query_id long, to long").distinct())
    visits = settle(asked.join(pairs, "query_id"))
    called = settle(visits.select("d", F.col("to").alias("home"), "party").distinct())
    hosts = docs.join(called, ["d", "home"])

    def second(queries: pa.Table, range_: pa.Table) -> pa.Table:
        if not queries.num_rows or not range_.num_rows:
            return answers([])
        blocks = Blocks(range_.column("vec_id").to_numpy(), matrix(range_.column("x"), range_.num_rows))
        out = []
        for q, w, low in zip(queries.column("query_id").to_pylist(), matrix(queries.column("x"), queries.num_rows), queries.column("least").to_pylist(), strict=True):
            out += [(q, v, s) for s, v in blocks.search(q, w, k, low)]
        return answers(out)

    far = visits.groupBy("d", "to", "party").cogroup(hosts.groupBy("d", "home", "party")).applyInArrow(second, FOUND)
    return (
        near.unionAll(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
