"""Exact n-gram Jaccard join of documents by prefixes under several global orders of the shingles.

If two sets of shingles are similar enough, their rarest shingles - the prefix under any global order - must
share some, and, for sets of given sizes, at least a certain number.  Each order gives such a filter: prefixes under
the first give candidate pairs, those under the others leave the pairs that pass all of them, and only then are whole
sets fetched and compared.  All orders put frequent shingles last, by counts over the whole corpus in a table of bounded
size; they differ in how they order shingles of one class of frequency.

Equal sets are joined first.  Short posting lists of the first order's prefixes give candidate pairs; documents that
meet in longer lists form clusters, which are compared block by block, so that large groups of near copies give a
spanning forest of links and never a list of pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.llm.components import components
from phaselens.llm.runtime import concluded, settle, sieve, slices

#: Bits of the table of counts, which follows the input's bytes between two bounds, and the parts it is summed in.
LEAST_BITS, MOST_BITS, CHUNKS = 20, 24, 64
#: Posting lists up to this length, or twice what the table of counts can't tell from rare, are paired in SQL.
SHORT = 64
#: Documents of a block of a cluster, and shingles of their sets.
BLOCK, BLOCK_GRAMS = 192, 2_000_000
#: Columns of the 0/1 matrices that a block comparison holds at once.
COLUMNS = 8192
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Bytes from which on a word's hash is made by a library call.
LONG = 64
#: Space and the control characters from tab to carriage return part words.
_PARTS = np.zeros(256, bool)
_PARTS[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[0]
    h = (h ^ (h >> np.uint64(29))) * ODD[1]
    return h ^ (h >> np.uint64(32))


def _word_hashes(raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; ``raw`` has eight bytes more than its last word.

    Each step is a bijection of the eight bytes, so no structure of letters in the word cancels out.
    """
    eight = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))
    h = length.astype(np.uint64) * ODD[3]
    short = np.flatnonzero(length < LONG)
    k = 0
    while len(short):
        rest = length[short] - 8 * k
        part = eight[begin[short] + 8 * k]
        part = np.where(rest < 8, part & ((np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1)), part)
        h[short] = _mix(h[short] ^ part)
        k += 1
        short = short[rest > 8]
    for i in np.flatnonzero(length >= LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : begin[i] + length[i]])
    return h


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' word ``size``-grams in order (not distinct), and where each text's begin (one more at the end).

    A-Z are lower-cased.  A text of fewer words gives its whole sequence as one; one without words gives none.
    """
    raw = np.frombuffer(b" ".join(t.lower() for t in texts) + b" " * 9, np.uint8)
    gap = _PARTS[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(begin, bounds)  # of words, by text
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = _word_hashes(raw, begin, end - begin)
    count = np.diff(first)
    grams = word[: max(0, len(word) - size + 1)] * ODD[0]
    for k in range(1, size):
        grams = _mix(grams + np.uint64(k)) + word[k : len(word) - size + 1 + k] * ODD[k % len(ODD)]
    grams = _mix(grams)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.empty(int(made.sum()), np.uint64)
    starts = np.concatenate([[0], np.cumsum(made)])
    long = np.repeat(count >= size, made)
    source = np.arange(len(out)) - np.repeat(starts[:-1] - first[:-1], made)
    out[long] = grams[source[long]]
    for k in np.flatnonzero((count > 0) & (count < size)).tolist():
        out[starts[k]] = _mix(np.array([xxhash.xxh3_64_intdigest(word[first[k] : first[k + 1]].tobytes())], np.uint64))[0]
    return out, starts


def least_shared(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of these sizes must share to reach the similarity."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return n - -(-percent * n // 100) + 1


def frequency_classes(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """A small class of frequency for each hash range: 0 for what can't be told from the mean, then by the logarithm; and the length of short posting lists.

    Counts of all documents' shingles are summed by the hash's leading bits, in steps of bounded groups.  The table has 2 ** LEAST_BITS
    entries or more, as the input has bytes, but 2 ** MOST_BITS at most.
    """
    octets = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(octets).bit_length() - 10))
    per = (1 << bits) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in slices(batches, "_text"):
            h, _ = shingles([t or b"" for t in b.column("_text").to_pylist()], size)
            total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            parts = [zlib.compress(total[k * per : (k + 1) * per].tobytes(), 1) for k in range(CHUNKS)]
            salt = TaskContext.get().partitionId() % 256
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "salt", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for c in group.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.int64)
        return pa.table({"chunk": group.column("chunk")[:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, salt int, counts binary"
    parts = docs.select("_text").mapInArrow(count, schema).groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    total = np.zeros(1 << bits, np.int64)
    for r in parts:
        total[r["chunk"] * per : (r["chunk"] + 1) * per] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    mean = np.median(total)
    noise = 5 * np.sqrt(mean + 1) + 1
    extra = total - mean - noise
    return np.where(extra > 0, 1 + np.floor(2 * np.log2(np.maximum(extra, 1))), 0).astype(np.uint8), max(SHORT, int(2 * noise))


def _ordered(u: np.ndarray, classes: np.ndarray, order: int, take: int) -> np.ndarray:
    """The first ``take`` of sorted distinct hashes under an order."""
    own = classes[(u >> np.uint64(65 - len(classes).bit_length())).astype(np.int64)]
    if order == 0:
        return u[np.argsort(own, kind="stable")[:take]]
    return u[np.lexsort((_mix(u * ODD[order % len(ODD)] + np.uint64(order)), own))[:take]]


def _common(rows: list[np.ndarray], half: int, square: bool) -> np.ndarray:
    """Sizes of the intersections of each of the first ``half`` sets with each of the others (of all, if square)."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    _, name, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    fresh = np.cumsum(seen > 1) - 1
    keep = seen[name] > 1
    owner, name = owner[keep], fresh[name[keep]]
    columns = int(fresh[-1]) + 1 if len(fresh) else 0
    out = np.zeros((n, n) if square else (half, n - half), np.float32)
    order = np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    for at in range(0, columns, COLUMNS):
        low, high = np.searchsorted(name, [at, at + COLUMNS])
        m = np.zeros((n, min(COLUMNS, columns - at)), np.float32)
        m[owner[low:high], name[low:high] - at] = 1
        out += m @ m.T if square else m[:half] @ m[half:].T
    return np.rint(out).astype(np.int64)


class _Forest:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


EDGES = "a long, b long"


def jaccard_components(df: DataFrame, size: int = 3, percent: int = 90, orders: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct word ``size``-grams
    (``shingles`` says of what words).  component_id is the smallest doc_id reachable by links, its own included.  Null and
    empty texts and those without words have no shingles and link with nothing.  Repeated rows are equal documents; a
    null doc_id stays null and links with nothing.  Further columns are ignored.
    """
    return concluded(lambda: _components(df, size, percent, orders, doc_id, text))


def _components(df: DataFrame, size: int, percent: int, orders: int, doc_id: str, text: str) -> DataFrame:
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    sc = df.sparkSession.sparkContext
    classes, short_list = frequency_classes(docs, size)
    shared = sc.broadcast(classes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for b in slices(batches, "_text"):
            h, starts = shingles([t or b"" for t in b.column("_text").to_pylist()], size)
            n, x, y, prefixes = [], [], [], []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                u = np.unique(h[low:high])
                n.append(len(u))
                name = xxhash.xxh3_128_digest(u.tobytes())
                x.append(int.from_bytes(name[:8], "little", signed=True))
                y.append(int.from_bytes(name[8:], "little", signed=True))
                prefixes.append(_ordered(u, classes, 0, prefix_length(len(u), percent) if len(u) else 0))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), lists], names=["doc_id", "n", "x", "y", "prefix"])

    signed = settle(docs.mapInArrow(sign, "doc_id long, n long, x long, y long, prefix array<long>"))
    some = signed.where("n > 0 and doc_id is not null")
    # one representative for equal sets
    reps = some.groupBy("x", "y").agg(F.min("doc_id").alias("rep"))
    names = settle(reps)
    first = some.join(names, [some.x == names.x, some.y == names.y, some.doc_id == names.rep], "left_semi").select(F.col("doc_id").alias("rep"), "n", "prefix").dropDuplicates(["rep"])
    posted = first.select("rep", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    lists = posted.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    # similar sets have similar sizes: a list is cut by classes of size, each with the next smaller class, so pairs lie in one part
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("n")
    part = F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("part")
    met = posted.join(lists.select("token"), "token").withColumn("own", own.cast("long")).select("token", "rep", "n", "pos", "own", part)
    met = settle(met)
    parts = met.groupBy("token", "part").agg(F.count("*").alias("size"), F.min("rep").alias("least"), F.max("own").alias("most")).where("size > 1 and most = part")
    parts = settle(parts)
    # clusters of the documents that meet in long lists
    hot = components(met.join(parts.where(F.col("size") > short_list), ["token", "part"]).select(F.col("least").alias("a"), F.col("rep").alias("b")))
    hot = settle(hot)
    # both sides of the pairing read one table, so the postings are looked up once
    short = settle(met.join(parts.where(F.col("size") <= short_list).select("token", "part"), ["token", "part"]))
    left, right = (short.select("token", "part", F.col("rep").alias(k), *(F.col(c).alias(f"{c}{k}") for c in ("n", "pos", "own"))) for k in "ab")
    # a shared token at places posa and posb has at most the fewer of both before it in common, and the fewer of both from it on;
    # this holds for every shared token of two similar sets, so their number stays whole
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    positional = F.least("posa", "posb") + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= least
    pairs = left.join(right, ["token", "part"]).where(
        (F.col("a") < F.col("b")) & (F.greatest("owna", "ownb") == F.col("part")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & positional
    )
    pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("shared"))
    beyond = lambda c: -F.floor(-percent * F.col(c) / 100) - 1  # noqa: E731  what a set has after its prefix
    enough = F.col("shared") + F.greatest(beyond("na"), beyond("nb")) >= least
    pairs = pairs.where(enough).select("a", "b", "na", "nb")
    ha, hb = (hot.select(F.col("node").alias(c), F.col("component").alias(f"h{c}")) for c in ("a", "b"))
    pairs = settle(pairs.join(ha, "a", "left").join(hb, "b", "left").where("ha is null or hb is null or ha <> hb").select("a", "b", "na", "nb"))
    # whole sets and the other orders' prefixes, for candidates only
    wanted = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).unionAll(hot.select("node")).distinct()
    wanted = settle(wanted)
    chosen = docs.where(sieve(wanted, F.col("doc_id"))).join(wanted, docs.doc_id == wanted.rep, "left_semi").dropDuplicates(["doc_id"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for b in slices(batches, "_text"):
            h, starts = shingles([t or b"" for t in b.column("_text").to_pylist()], size)
            rows = [np.unique(h[a:z]) for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            others = [[_ordered(u, classes, k, prefix_length(len(u), percent)).view(np.int64) for k in range(1, orders)] for u in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, rows), pa.int64()), pa.array([u.tobytes() for u in rows], pa.binary()), pa.array(others, pa.list_(pa.list_(pa.int64())))], names=["rep", "n", "grams", "others"]
            )

    sets = settle(chosen.mapInArrow(expand, "rep long, n long, grams binary, others array<array<long>>"))

    def pass_all(rows: list[np.ndarray], half: int, square: bool, classes: np.ndarray) -> np.ndarray:
        """Pairs that pass the length filter and every order's filter."""
        n = np.array([len(r) for r in rows])
        na, nb = (n, n) if square else (n[:half], n[half:])
        small, large = np.minimum(na[:, None], nb[None]), np.maximum(na[:, None], nb[None])
        ok = 100 * small >= percent * large
        if square:
            ok = np.triu(ok, 1)
        p = prefix_length(n, percent)
        rest = n - p
        ra, rb = (rest, rest) if square else (rest[:half], rest[half:])
        need = least_shared(na[:, None], nb[None], percent) - np.maximum(ra[:, None], rb[None])
        for k in range(orders):
            if not ok.any():
                break
            ok &= _common([_ordered(r, classes, k, int(q)) for r, q in zip(rows, p.tolist(), strict=True)], half, square) >= np.maximum(need, 1)
        return ok

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, c, ga, gc in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("ga"), b.column("gc"), strict=True):
                u, v = np.frombuffer(ga.as_buffer(), np.uint64), np.frombuffer(gc.as_buffer(), np.uint64)
                if len(np.intersect1d(u, v, True)) >= int(least_shared(len(u), len(v), percent)):
                    out.append((a, c))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # pairs must share enough of their prefixes under all other orders before whole sets are fetched
    oa, ob = sets.select(F.col("rep").alias("a"), F.col("others").alias("oa")), sets.select(F.col("rep").alias("b"), F.col("others").alias("ob"))
    few = F.greatest(F.lit(1), least - F.greatest(beyond("na"), beyond("nb")))
    alike = F.lit(True)
    for k in range(orders - 1):
        alike &= F.size(F.array_intersect(F.get("oa", F.lit(k)), F.get("ob", F.lit(k)))) >= few
    passed = settle(pairs.join(oa, "a").join(ob, "b").where(alike).select("a", "b"))
    ga, gc = sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("rep").alias("b"), F.col("grams").alias("gc"))
    links = passed.join(ga, "a").join(gc, "b").select("a", "b", "ga", "gc").mapInArrow(verify, EDGES)

    # blocks of a cluster with each other
    weighed = hot.join(sets.select(F.col("rep").alias("node"), "n"), "node")
    sizes = weighed.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    member = hot.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    member = member.select(F.col("node").alias("rep"), "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own, rep = group.column("own").to_numpy(), group.column("rep").to_numpy()
        order = np.lexsort((rep, own))
        own, rep = own[order], rep[order]
        grams = group.column("grams").to_pylist()
        rows = [np.frombuffer(grams[k], np.uint64) for k in order.tolist()]
        square, half = i == j, int((own == i).sum())
        edges, forest = [], _Forest(len(rows))
        if square or 0 < half < len(rows):
            ok = pass_all(rows, half, square, shared.value)
            if ok.any():
                n = np.array([len(r) for r in rows])
                na, nb = (n, n) if square else (n[:half], n[half:])
                ok &= _common(rows, half, square) >= least_shared(na[:, None], nb[None], percent)
                for p, q in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                    q += 0 if square else half
                    if forest.join(p, q):
                        edges.append((rep[p], rep[q]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    within = member.join(sets.select("rep", "grams"), "rep").groupBy("component", "i", "j").applyInArrow(compare, EDGES)
    roots = components(links.unionAll(within))
    named = names.join(roots, names.rep == roots.node, "left").select("x", "y", F.coalesce("component", "rep").alias("component"))
    linked = some.select("doc_id", "n", "x", "y").join(named, ["x", "y"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = signed.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)


def keep_one(df: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` without near copies: of each component the rows with the smallest doc_id stay, with all their columns.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id all stay or go together.
    """
    found = jaccard_components(df, size, percent, doc_id=doc_id, text=text)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df[doc_id] == gone["_gone"], "left_anti")
