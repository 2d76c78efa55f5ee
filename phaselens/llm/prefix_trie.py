"""A trie of conversations by shared first turns, from chained digests of their prefixes.

A turn is known by the SHA-256 of its role and text, a prefix by the SHA-256 of the shorter prefix's digest and the last
turn's.  Every prefix of every conversation is a row; rows that agree in depth and digest are one node.  A node's weight goes
to all its ancestors, which are the shorter prefixes of any of its members: the member with the smallest id stands for it.
Weights that one conversation sends to the same ancestor are added up before they are dealt out, so a conversation of many
turns makes a row for each of its prefixes and not for each pair of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaselens.llm.runtime import concluded, settle

#: Ids that are joined to one piece of text before a node's pieces meet.
PIECE = 65_536
#: The digest of the prefix without turns.
ROOT = hashlib.sha256(b"").digest()
TURNS = ["conv_id", "place", "digest", "n_bytes"]


def turn_digests(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, digest, n_bytes): each turn's place in its conversation from 0 on, digest, and UTF-8 bytes of its text.

    Null roles and texts are empty, null turn numbers come first; turns with equal numbers are in the order of their digests, so
    repeated rows are further turns.  Rows without a conversation are left out, further columns ignored.  Texts aren't shuffled.
    """
    said, words = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    told = F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, words)
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.unhex(F.sha2(told, 256)).alias("digest"), F.octet_length(words).cast("long").alias("n_bytes")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "digest", "n_bytes")


def rebuilt(turns: DataFrame, by: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin as another one, and the ids (conv_id) of all of them, turnless ones too.

    The first h turns of conversation c are those of c - c % by (all if it has fewer, none if it isn't there), and then its own ones
    after its first h; h is the CRC-32 of c's decimal digits modulo ``most``.  ``turns`` is read twice.
    """
    h: Column = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    ids = turns.where("place = 0").select("conv_id")
    takers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % by).alias("from"), h.alias("h"))
    given = turns.where(F.col("place") < most - 1).withColumnRenamed("conv_id", "from").join(takers, "from").where("place < h").select(TURNS)
    return turns.where(F.col("place") >= h).select(TURNS).unionByName(given), ids


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations whose turns follow one another, each behind a row without digest; a prefix is the last if its conversation goes no further."""
    held: tuple | None = None
    names = ["conv_id", "depth", "digest", "parent", "n_bytes", "last"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        out = []
        for conv, turn, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "n_bytes")), strict=True):
            if held:
                out.append((*held, turn is None))
            if turn is None:
                held = (conv, 0, ROOT, None, 0)
            else:
                held = (conv, held[1] + 1, hashlib.sha256(held[2] + turn).digest(), held[2], size)
        if out:
            yield table(out)
    if held:
        yield table([(*held, True)])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a node's ids: decimal, comma-joined, with the first of them."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], names=["digest", "first", "ids"])

    for batch in batches:
        for own, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (own != key or len(ids) == PIECE):
                yield piece()
                ids = []
            key = own
            ids.append(conv)
    if ids:
        yield piece()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which follow one another."""
    key, now, keys, found = None, None, [], []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["digest", "ends_sha256"])

    for batch in batches:
        for own, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own == key:
                now.update(b"," + ids.encode())
                continue
            if now:
                keys.append(key)
                found.append(now.hexdigest())
            key, now = own, hashlib.sha256(ids.encode())
        if keys:
            yield table()
            keys, found = [], []
    if now:
        keys, found = [key], [now.hexdigest()]
        yield table()


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The trie's nodes: depth, digest, parent (its digest), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` is as ``turn_digests`` gives it (places may have gaps), ``conversations`` (conv_id, each once) names those without turns
    too.  The root has depth 0 and no text; without conversations there are no nodes.  conv_id is the smallest member, saved_tokens
    the sum over a node's subtree of (members - 1) times the bytes of its last text, ends_sha256 the digest of the ids of the
    members that end there.

    A conversation's turns pass one worker as a stream, as a digest needs the one before it; nothing is held but the last.  The ids
    that end in one node are joined in pieces first, so one worker hashes its pieces.
    """
    return concluded(lambda: _trie(turns, conversations))


def _trie(turns: DataFrame, conversations: DataFrame | None) -> DataFrame:
    ids = conversations if conversations is not None else turns.select("conv_id").distinct()
    marks = ids.select("conv_id", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    ordered = turns.select(TURNS).unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    prefixes = settle(ordered.select("conv_id", "digest", "n_bytes").mapInArrow(chained, "conv_id long, depth long, digest binary, parent binary, n_bytes long, last boolean"))
    node = ["depth", "digest"]
    nodes = settle(
        prefixes.groupBy(node).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("n_bytes").alias("n_bytes"), F.count(F.when(F.col("last"), 1)).alias("n_ends")
        )
    )
    # a node's weight stands with its smallest member; behind the prefixes of that depth it is in the sums of this and all shorter ones
    weights = nodes.select(
        "conv_id", "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf")
    )
    both = weights.unionByName(prefixes.select("conv_id", "depth", "digest", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf")))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("depth"), F.col("digest").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.select("depth", "digest", F.sum("saved").over(behind).alias("saved"), F.sum("leaf").over(behind).alias("leaf")).where("digest is not null")
    below = sums.groupBy(node).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    pieces = prefixes.where("last").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(joined, "digest binary, first long, ids string")
    ends = pieces.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")
    told = nodes.join(below, node).join(children, node, "left").join(ends, "digest", "left")
    # the root has the smallest conversation of all, so only deeper nodes look for their parent's
    parents = nodes.where("n_convs > n_ends and depth > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("_parent"))
    least = nodes.where("depth = 0").select("conv_id").scalar()
    return told.join(parents, "parent", "left").select(
        "depth", "digest", "parent", "conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("_parent")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations of ``df`` (conv_id, turn, role, text), without the digests."""

    def make() -> DataFrame:
        turns, ids = rebuilt(settle(turn_digests(df)))
        return prefix_trie(turns, ids).drop("digest", "parent")

    return concluded(make)


#: Prefixes as whole texts, and each node's ancestors one by one.
CRC32 = """xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT), lambda c, b:
  list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT))"""

SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) - 1 AS pos FROM t
), k AS (SELECT c, {CRC32.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT o.* FROM o JOIN k USING (c) WHERE pos >= h
  UNION ALL SELECT k.c, o.role, o.text, o.pos FROM k JOIN o ON o.c = k.c - k.c % 5 WHERE o.pos < k.h
), q AS (
  SELECT c, row_number() OVER w AS depth, string_agg(concat(strlen(role), ':', role, strlen(text), ':', text), '') OVER w AS path, strlen(text) AS bytes FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)
  UNION ALL SELECT c, 0, '', 0 FROM k
), p AS (SELECT *, lag(path) OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS last FROM q),
n AS (
  SELECT depth, path, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, bool_and(last) AS leaf,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY depth, path
), a AS (
  SELECT p.depth, p.path, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves
  FROM n JOIN p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.path
), h AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(h.n_children, 0)::BIGINT AS n_children, a.n_leaves, a.saved_tokens, n.ends_sha256
FROM n JOIN a USING (depth, path) LEFT JOIN h USING (depth, path) LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.up
"""
