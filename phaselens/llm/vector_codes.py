"""Compression of vectors into codes of their parts, with codebooks of whole numbers.

Vectors are scaled and floored, and cut into equal parts; each part position has a codebook.  A round sends the codebooks to
all tasks; each batch's squared distances are |x|^2 - 2 x.c + |c|^2 in 64-bit integers, which are exact, and a task
hands on sums and counts of its parts by entry, which one grouped shuffle merges.  The driver gets the merged sums only,
as many as the codebooks have numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.llm.runtime import concluded, settle
from phaselens.llm.topk import matrix


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances (rows, parts) of parts x (rows, parts, width) by books (parts, entries, width); the first of equals.

    Integers wrap, so only the distances themselves have to fit.
    """
    parts = x.transpose(1, 0, 2)
    distance = (parts * parts).sum(2)[:, :, None] - 2 * (parts @ books.transpose(0, 2, 1)) + (books * books).sum(2)[:, None, :]
    entry = distance.argmin(2)
    return entry.T, np.take_along_axis(distance, entry[:, :, None], 2)[:, :, 0].T


def limit(dimension: int) -> int:
    """Components below this in size keep a whole vector's distance within 63 bits."""
    return int((2**61 / dimension) ** 0.5)


def compress(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6
) -> tuple[DataFrame, np.ndarray]:
    """A row (vec_id, label, code binary, error) for each vector, and the codebooks (parts, entries, width).

    ``code`` has a byte for each part (``entries`` are 256 at most).  Vectors that are null or hold null or non-finite components are left out.  The
    dimension is that of the vector with the smallest vec_id, a multiple of ``parts``; vectors of another length, and those with a scaled component
    too large for exact distances (``limit``: 189812531 at 64 dimensions), stay with a null code and error and don't count for the
    codebooks.  Codebooks start from the ``entries`` smallest vec_ids, of equal ones from the smaller vector; rows without
    vec_id and repeated rows are coded and counted like others.  With fewer vectors codebooks have fewer entries.
    """
    v = F.col("_v")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("_v")).where(fine)
    least = rows.where("vec_id is not null").orderBy("vec_id", "_v").select(F.size("_v")).first()
    d = least[0] if least and least[0] % parts == 0 else 0
    most = limit(max(1, d))
    scaled = F.transform(v, lambda c: F.floor(c * float(scale)))
    usable = (F.size(v) == d) & (F.size(v) > 0) & F.forall(v, lambda c: (c * float(scale) < most) & (c * float(scale) >= -most))
    kept = settle(rows.select("vec_id", "label", F.when(usable, scaled).cast("array<int>").alias("x")))
    first = kept.where("x is not null and vec_id is not null").orderBy("vec_id", "x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, d // parts).transpose(1, 0, 2)
    context, width = df.sparkSession.sparkContext, d // parts
    for _ in range(rounds if first else 0):
        sent = context.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value
            total, count = np.zeros_like(now), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0), batch.num_rows).reshape(-1, parts, width)
                    own = nearest(x, now)[0].T[:, None, :] == np.arange(now.shape[1])[:, None]
                    count += own.sum(2)
                    total += own.astype(np.int64) @ x.transpose(1, 0, 2)
            at = np.argwhere(count)
            held = total[at[:, 0], at[:, 1]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, width, dtype=np.int32)), pa.array(held.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(count[at[:, 0], at[:, 1]]), lists], names=["part", "entry", "n", "total"])

        found = kept.where("x is not null").select("x").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        merged = found.select("part", "entry", "n", F.posexplode("total").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        books = books.copy()
        for r in merged.collect():
            books[r["part"], r["entry"], r["at"]] = r["v"] // r["n"]
        sent.unpersist()
    sent = context.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
            code, error = np.full(len(ok), None, object), np.zeros(len(ok), np.int64)
            if ok.any():
                entry, distance = nearest(matrix(batch.column("x").filter(pa.array(ok)), int(ok.sum())).reshape(-1, parts, width), sent.value)
                code[ok] = [e.tobytes() for e in entry.astype(np.uint8)]
                error[ok] = distance.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.binary()), pa.array(error, mask=~ok)], names=["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(codes, f"vec_id long, label {kind}, code binary, error long"), books


def code_digest(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error, codebooks_sha256; see ``compress``. label_error is null where it is no long."""

    def make() -> DataFrame:
        coded, books = compress(df, vec_id, vector, label)
        coded = settle(coded)
        told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        totals = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")))
        return coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256"))

    return concluded(make)


def code_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of ``code_digest``: each round's assignment and codebooks are tables of their own."""
    out = [f"""
v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (SELECT rid, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS y FROM v, range({parts}) t(p)),
i AS (SELECT rid, row_number() OVER (ORDER BY vec_id, x) - 1 AS k FROM v WHERE vec_id IS NOT NULL QUALIFY k < {entries}),
c0 AS (SELECT p, k, y AS c FROM i JOIN s USING (rid))"""]
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS (SELECT rid, s.p, any_value(y) AS y, min(list_sum(list_transform(range(1, len(y) + 1), lambda j: (y[j] - c[j]) * (y[j] - c[j])))::BIGINT * {entries} + k) AS m FROM s JOIN c{r} c ON c.p = s.p GROUP BY rid, s.p)""")
        if r < rounds:
            out.append(f"""
g{r} AS (SELECT p, k, j, sum(y)::BIGINT AS g, count(*) AS n FROM (SELECT p, m % {entries} AS k, unnest(range(1, len(y) + 1)) AS j, unnest(y) AS y FROM a{r}) GROUP BY ALL),
u{r} AS (SELECT p, k, list((g - ((g % n) + n) % n) // n ORDER BY j) AS c FROM g{r} GROUP BY p, k),
c{r + 1} AS (SELECT c.p, c.k, coalesce(u.c, c.c) AS c FROM c{r} c LEFT JOIN u{r} u ON u.p = c.p AND u.k = c.k)""")
    return "WITH " + ",".join(out) + f""",
e AS (SELECT rid, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (rid), b
"""
