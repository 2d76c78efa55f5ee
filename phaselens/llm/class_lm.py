"""Class-based bigram language model: exchange clustering, and smoothed class transitions and word emissions.

A word's probability after another is P(its class | the other's class) * P(word | its class).  Texts are tokenised once, into chunks
of some millions of characters with a dictionary of their own, so what is shuffled afterwards is a row for each word of a chunk and
not for each token.  Classes are found by exchange: a word moves to the class that raises the likelihood of class
bigrams most.  The most frequent words, ``frequent`` of them at most, are exchanged in rounds with their classes
sent to all tasks; all other words, however many, then meet by word in a shuffle, where each takes its best class.
All counts are over all training texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.llm.runtime import concluded, release, settle, slices

#: Bytes of text in a chunk, or one longer text.
CHUNK = 16_000_000
#: The word that ends a text; words hold no white space. Longer words than LONG bytes are known by a digest behind such a sign.
END, LONG = "\n", 64
#: Entries of words' contexts that are looked at together.
ENTRIES = 50_000
#: Tokens, or words and their contexts, that one vectorised step takes; a chunk has some millions.
PIECE = 1 << 19
#: Bytes in an Arrow batch sent to a worker, or one row: chunks go one by one.
BATCH = 4_000_000


def coded(piece: pa.RecordBatch) -> tuple:
    """Of some texts (doc_id, text, held): ids, held, numbers of tokens, and the words' codes behind 0 for the ends, in a dictionary of their own."""
    texts = pc.fill_null(piece.column("text"), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    doc, words = doc[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    tokens = np.zeros(int(sizes.sum()), np.uint32)
    tokens[np.arange(len(doc)) + doc] = words.indices.to_numpy(zero_copy_only=False) + 1
    ids = piece.column("doc_id").take(pa.array(np.arange(len(texts))))  # a slice would keep its batch
    return ids, piece.column("held").to_numpy(zero_copy_only=False), sizes, tokens, words.dictionary


def chunk_row(pieces: list[tuple], name: int) -> pa.RecordBatch:
    """One row of coded texts: tokens are places in ``words``, which has the end first and then words by count; n counts training tokens."""
    ids, held, sizes, codes, dictionaries = zip(*pieces, strict=True)
    # the dictionaries as one, in which each piece's words have these places
    merged = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(np.arange(len(d), dtype=np.int32)), d) for d in dictionaries]).unify_dictionaries()
    words = merged.chunk(0).dictionary
    codes = [np.append(np.uint32(0), c.indices.to_numpy().astype(np.uint32) + np.uint32(1))[t] for c, t in zip(merged.chunks, codes, strict=True)]
    times = sum(np.bincount(t, minlength=len(words) + 1) for t in codes)
    order = np.argsort(-times[1:], kind="stable")
    place = np.zeros(len(order) + 1, "<u4")
    place[order + 1] = np.arange(1, len(order) + 1)
    codes = [place[t] for t in codes]
    n = sum(np.bincount(t[~np.repeat(h.astype(bool), z)], minlength=len(order) + 1) for t, h, z in zip(codes, held, sizes, strict=True))
    held, sizes, tokens = np.concatenate(held).astype(bool), np.concatenate(sizes), np.concatenate(codes)
    words = words.take(pa.array(order))
    long = pc.greater(pc.binary_length(words), LONG)
    if pc.any(long).as_py():
        names = [END + hashlib.sha256(w.encode()).hexdigest() for w in words.filter(long).to_pylist()]
        words = pc.replace_with_mask(words, long, pa.array(names, words.type))
    words = pa.concat_arrays([pa.array([END], words.type), words])
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), one(pa.concat_arrays(ids)), one(pa.array(held)), one(pa.array(np.cumsum(sizes))), pa.array([tokens.tobytes()], pa.binary()), one(words.cast(pa.string())), one(pa.array(n))],
        names=["chunk", "doc_ids", "held", "ends", "tokens", "words", "n"],
    )


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's texts, named by the task's number and theirs."""
    part, k, now, size = TaskContext.get().partitionId(), 0, [], 0
    for piece in slices(batches, "text"):
        now.append(coded(piece))
        size += piece.column("text").nbytes
        if size >= CHUNK:
            yield chunk_row(now, part << 32 | k)
            k, now, size = k + 1, [], 0
            pa.default_memory_pool().release_unused()
    if now:
        yield chunk_row(now, part << 32 | k)


def bigrams(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training tokens of a chunk, and those before them, piece by piece; the end comes before a text's first."""
    tokens = np.frombuffer(row["tokens"].as_buffer(), "<u4")
    ends = row["ends"].values.to_numpy()
    known = np.repeat(~row["held"].values.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
    for i in range(0, len(tokens), PIECE):
        some = known[i : i + PIECE]
        token = tokens[i : i + PIECE].astype(np.int64)
        yield token[some], np.append(tokens[i - 1] if i else 0, token[:-1])[some]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}
            pa.default_memory_pool().release_unused()


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where words stand in another list of words, else -1."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for what no exchange of words changes."""
    return float(xlogx(counts).sum() - xlogx(counts.sum(0)).sum() - xlogx(counts.sum(1)).sum())


def gains(counts: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, twice: int) -> np.ndarray:
    """What the likelihood gains in each class that a word of class ``own`` may go to once it is taken from there.

    left and right count the classes of other words before and behind it, ``twice`` it behind itself.
    """
    m = counts.copy()
    m[:, own] -= left
    m[own] -= right
    m[own, own] -= twice
    f, total = xlogx(m), m.sum(1)
    n = left.sum() + twice
    found = (xlogx(m + left[:, None]) - f).sum(0) + (xlogx(m + right) - f).sum(1)
    d, g = np.diagonal(m), np.diagonal(f)
    found += xlogx(d + left + right + twice) + g - xlogx(d + left) - xlogx(d + right)
    return found - 2 * (xlogx(total + n) - xlogx(total))


def first_classes(words: list[str], classes: int) -> np.ndarray:
    """Classes of words by frequency: a class for each of the first, the others are dealt over the rest; the end has class 0 alone."""
    half = (classes - 1) // 2
    rank = np.arange(len(words))
    return np.where(rank < half, 1 + rank, half + 1 + (rank - half) % (classes - 1 - half))


def exchange(chunks: DataFrame, words: list[str], classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of frequent words, and counts of class bigrams; words that aren't frequent are a class of their own behind the others.

    Half of the words, in turns, move at once in a round, all by the same counts.  A round after which the likelihood is less is taken
    back.  Counts of words' contexts are summed in each task, then by a grouped shuffle; a number for each word comes back.
    """
    context, k, width = chunks.sparkSession.sparkContext, classes + 1, 2 * classes + 3
    among = pa.array(words, pa.string())
    turn = np.array([zlib.crc32(w.encode()) >> 7 & 1 for w in words], np.int64)
    now, best = first_classes(words, classes), None
    for r in range(rounds + 1):
        moving = turn == r % 2
        sent = context.broadcast((among, now, moving & (r < rounds)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            among, now, moving = sent.value
            pairs, around = np.zeros(k * k, np.int64), np.zeros(len(now) * width, np.int64)
            for row in rows_of(batches):
                at = places(row["words"].values, among)
                own = np.append(now, classes)[at]
                own[0] = 0
                mover = np.where((at >= 0) & np.append(moving, False)[at], at, -1)
                for token, before in bigrams(row):
                    pairs += np.bincount(own[before] * k + own[token], minlength=k * k)
                    same = token == before
                    m = mover[token]
                    around += np.bincount((m * width + np.where(same, 2 * k, own[before]))[m >= 0], minlength=len(around))
                    m = np.where(same, -1, mover[before])
                    around += np.bincount((m * width + k + own[token])[m >= 0], minlength=len(around))
            for word, of in ((-1, pairs), (0, around)):
                at = np.flatnonzero(of)
                for i in range(0, len(at), 100_000):
                    some = at[i : i + 100_000]
                    row, ctx = (np.full(len(some), -1), some) if word < 0 else divmod(some, width)
                    yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(ctx.astype(np.int32)), pa.array(of[some])], names=["word", "ctx", "n"])

        counted = chunks.select("tokens", "words", "ends", "held").mapInArrow(count, "word int, ctx int, n long")
        summed = settle(counted.groupBy("word", "ctx").agg(F.sum("n").alias("n")), batch=BATCH)
        counts = np.zeros(k * k, np.int64)
        for ctx, n in summed.where("word = -1").select("ctx", "n").collect():  # classes squared
            counts[ctx] = n
        counts = counts.reshape(k, k)
        score = likelihood(counts)
        if best and score < best[0]:
            now, counts = best[1], best[2]  # the words of the other half move next
        else:
            best = (score, now, counts)
        if r == rounds:
            release(summed)
            break
        told = context.broadcast((counts, now))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, now = told.value
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            ids, row = np.unique(table.column("word").to_numpy(), return_inverse=True)
            around = np.zeros((len(ids), width), np.int64)
            around[row, table.column("ctx").to_numpy()] = table.column("n").to_numpy()
            to = []
            for i, x in zip(ids.tolist(), around, strict=True):
                found = gains(counts, now[i], x[:k], x[k : 2 * k], x[2 * k])[1:classes]
                to.append(int(found.argmax()) + 1 if found.max() > found[now[i] - 1] + 1e-6 else int(now[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(to, pa.int32())], names=["word", "class"])

        # if the last moves were taken back, contexts are of classes that no longer hold, so nothing moves
        if best[1] is now and score == best[0]:
            moved = summed.where("word >= 0").repartition("word").mapInArrow(choose, "word int, class int").toArrow()
            now = now.copy()
            now[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
        release(summed)
        sent.unpersist()
        told.unpersist()
    return best[1], best[2]


def word_rows(sent) -> callable:
    """For each word of a chunk: word, chunk, at (its place there), n, class (-1 where it is to be found), and its contexts, five bytes for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, now, classes = sent.value
        k = classes + 1
        kind = np.dtype([("ctx", "u1"), ("n", "<u4")])
        for row in rows_of(batches):
            words, n = row["words"].values, row["n"].values
            at = places(words, among)
            own = np.append(now, classes)[at]
            own[0] = 0
            rare = own == classes
            number = np.uint32 if len(words) * 2 * k < 1 << 32 else np.int64
            keys = []
            for token, before in bigrams(row):
                left, right = rare[token], rare[before]
                keys += [(token[left] * 2 * k + own[before[left]]).astype(number), (before[right] * 2 * k + k + own[token[right]]).astype(number)]
            keys = np.concatenate(keys or [np.zeros(0, number)])
            keys.sort()
            stops = np.searchsorted(keys, (2 * k * np.arange(len(words) + 1)).astype(number))
            load, at = stops + np.arange(len(stops)), 0
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(load, load[at] + PIECE, "right")) - 1)
                some, each = slice(at, to), np.arange(at, to, dtype=np.int32)
                key, times = np.unique(keys[stops[at] : stops[to]], return_counts=True)
                entries = np.empty(len(key), kind)
                entries["ctx"], entries["n"] = key % (2 * k), times
                bounds = np.searchsorted(key.astype(np.int64), 2 * k * np.arange(at, to + 1)) * kind.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [words[some], pa.array(np.full(len(each), row["chunk"].as_py())), pa.array(each), n[some], pa.array(np.where(rare, -1, own)[some].astype(np.int32)), packed],
                    names=["word", "chunk", "at", "n", "class", "around"],
                )
                at = to

    return run


def best_classes(entries: np.ndarray, word: np.ndarray, total: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """Each word's best class by the contexts of its tokens; entries (ctx, n) are in the order of ``word``."""
    k, f = classes + 1, xlogx(counts)
    margin = counts.sum(1)[1:classes]
    key, back = np.unique(word * 2 * k + entries["ctx"], return_inverse=True)
    n = np.bincount(back, entries["n"]).astype(np.int64)
    most = int(n.max(initial=0)) + 1
    word, ctx = np.divmod(key, 2 * k)
    out, starts = np.zeros(len(total), np.int64), np.searchsorted(word, np.arange(len(total) + 1))
    at = 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + ENTRIES, "right")) - 1)
        some = slice(starts[at], starts[to])
        kinds, which = np.unique(ctx[some] * most + n[some], return_inverse=True)
        side, x = np.divmod(kinds, most)
        base, old = np.where((side < k)[:, None], counts[side % k], counts.T[side % k]), np.where((side < k)[:, None], f[side % k], f.T[side % k])
        each = (xlogx(base + x[:, None]) - old)[:, 1:classes]
        score = np.zeros((to - at, classes - 1))
        full = np.flatnonzero(starts[at + 1 : to + 1] > starts[at:to])
        if len(full):
            score[full] = np.add.reduceat(each[which], starts[at:to][full] - starts[at], axis=0)
        score -= 2 * (xlogx(margin + total[at:to, None]) - xlogx(margin))
        out[at:to] = score.argmax(1) + 1
        at = to
    return out


def classified(sent) -> callable:
    """(chunk, at, class, n, first) of rows that come sorted by word: the word's class and its count in all chunks; ``first`` marks one row of a word.

    A word's rows, at most one for each chunk, are looked at together.  Words of held-out texts only have no class (-1).
    """

    def done(table: pa.Table) -> pa.RecordBatch:
        counts, classes = sent.value
        word = table.column("word").combine_chunks().dictionary_encode().indices.to_numpy()
        around = table.column("around").combine_chunks()
        total = np.bincount(word, table.column("n").to_numpy()).astype(np.int64)
        stops = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1]
        kind = np.dtype([("ctx", "u1"), ("n", "<u4")])
        entries = np.frombuffer(around.buffers()[2] or b"", np.uint8)[stops[0] : stops[-1]].view(kind)
        best = best_classes(entries, np.repeat(word, np.diff(stops) // kind.itemsize), total, counts, classes)
        best[total == 0] = -1
        given = table.column("class").to_numpy()
        own = np.where((given >= 0) & (total[word] > 0), given, best[word])
        first = np.diff(word, prepend=-1) > 0
        return pa.RecordBatch.from_arrays([table.column("chunk").combine_chunks(), table.column("at").combine_chunks(), pa.array(own.astype(np.int32)), pa.array(total[word]), pa.array(first)], names=["chunk", "at", "class", "n", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            if waiting and words[0] != waiting[-1].column("word")[-1]:
                yield done(pa.Table.from_batches(waiting))
                waiting = []
            if words[0] == words[-1]:
                waiting.append(batch)
                continue
            cut = pc.index(words, words[-1]).as_py()
            yield done(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = [batch.slice(cut)]
        if waiting:
            yield done(pa.Table.from_batches(waiting))

    return run


def with_classes(classes: int) -> callable:
    """A chunk with the class and the count of each of its words, and its counts of class bigrams."""
    schema = "chunk long, doc_ids array<long>, held array<boolean>, ends array<long>, tokens binary, class binary, n binary, pairs array<long>"

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        own, n = np.full(found.num_rows, -1, np.int16), np.zeros(found.num_rows, np.int64)
        own[found.column("at").to_numpy()], n[found.column("at").to_numpy()] = found.column("class").to_numpy(), found.column("n").to_numpy()
        chunk = chunk.combine_chunks()
        pairs = np.zeros(classes**2, np.int64)
        for token, before in bigrams({c: chunk.column(c)[0] for c in ("tokens", "ends", "held")}):
            pairs += np.bincount(np.maximum(own[before], 0).astype(np.int64) * classes + np.maximum(own[token], 0), minlength=classes**2)
        lists = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs))
        return pa.table([*(chunk.column(c) for c in ("chunk", "doc_ids", "held", "ends", "tokens")), pa.array([own.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), lists], names=["chunk", "doc_ids", "held", "ends", "tokens", "class", "n", "pairs"])

    run.schema = schema
    return run


@dataclass
class Model:
    """counts: class bigrams; once: words seen once by class; tokens and words: of the training texts, the end included."""

    counts: np.ndarray
    once: np.ndarray
    tokens: int
    words: int

    def __post_init__(self):
        k = len(self.counts)
        size = self.counts.sum(0)
        rare = self.once + 1.0
        if size[0]:
            rare[0] = 0  # the end's class has no other word
        prior = (size + 1) / (size.sum() + k)
        follow = self.counts.sum(1)
        kinds = np.maximum(1, (self.counts > 0).sum(1))
        step = (self.counts + kinds[:, None] * prior) / (follow + kinds)[:, None]
        new = rare / (size + rare)
        step = np.vstack([step, rare / rare.sum() @ step])
        with np.errstate(divide="ignore"):
            #: log10 of P(class | class); behind them unknown words, as a class of one word.
            self.step = np.log10(np.hstack([step, (step @ new)[:, None]]))
        #: Tokens of a class, and those that unknown words count for.
        self.held = size + rare

    def scores(self, own: np.ndarray, n: np.ndarray, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, the number of known tokens and log10 probabilities by the base and by classes; own and n are the words' classes and counts."""
        k = len(self.counts)
        known = n > 0
        kind = np.where(known, own, k)
        emission = np.zeros(len(n))
        emission[known] = np.log10(n[known] / self.held[own[known]])
        base = np.log10((n + 1) / (self.tokens + self.words + 1))
        out, at = ([], [], []), 0
        while at < len(ends):
            start = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + PIECE, "right")))
            some = tokens[start : ends[to - 1]]
            starts = np.append(start, ends[at : to - 1]) - start
            before = np.append(0, kind[some[:-1]])
            before[starts] = 0  # texts begin behind the end, known or not
            each = known[some].astype(np.int64), base[some], self.step[before, kind[some]] + emission[some]
            for x, e in zip(out, each, strict=True):
                x.append(np.add.reduceat(e, starts))
            at = to
        return tuple(map(np.concatenate, out))


def fit(df: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", classes: int = 64, frequent: int = 16_384, rounds: int = 4) -> tuple[Model, DataFrame]:
    """The model learnt from the texts for which ``held`` doesn't hold, and the chunks of all texts with their words' classes and counts."""
    if not 4 <= classes <= 126:
        raise ValueError("classes must be from 4 to 126")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    schema = "chunk long, doc_ids array<long>, held array<boolean>, ends array<long>, tokens binary, words array<string>, n array<long>"
    chunks = settle(rows.mapInArrow(encoded, schema), "zstd", BATCH)
    vocabulary = settle(chunks.select(F.explode(F.arrays_zip("words", "n")).alias("w")).where("w.n > 0").groupBy("w.words").agg(F.sum("w.n").alias("n")))
    tokens, words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # sixteenths of octaves of counts, from the top while they hold no more than ``frequent`` words
    level = F.floor(F.log2("n") * 16)
    among, least = 0, 1 << 20
    for at, n in vocabulary.where(F.col("words") != END).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        among += n
        if among > frequent:
            break
        least = at
    often = vocabulary.where((level >= least) & (F.col("words") != END)).orderBy(F.desc("n"), "words").select("words")
    names = [r[0] for r in often.collect()]
    release(vocabulary)
    own, counts = exchange(chunks, names, classes, rounds)
    context = df.sparkSession.sparkContext
    sent = context.broadcast((pa.array(names, pa.string()), own, classes))
    told = context.broadcast((counts, classes))
    each = chunks.select("chunk", "words", "n", "tokens", "ends", "held").mapInArrow(word_rows(sent), "word string, chunk long, at int, n long, class int, around binary")
    met = each.repartition("word").sortWithinPartitions("word")
    found = settle(met.mapInArrow(classified(told), "chunk long, at int, class int, n long, first boolean"), "zstd", BATCH)
    once = np.zeros(classes, np.int64)
    for c, n in found.where("first and n = 1").groupBy("class").count().collect():
        once[c] = n
    finish = with_classes(classes)
    left, right = chunks.select("chunk", "doc_ids", "held", "ends", "tokens"), found.select("chunk", "at", "class", "n")
    done = settle(left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(finish, finish.schema), "zstd", BATCH)
    release(chunks)
    release(found)
    pairs = np.zeros(classes**2, np.int64)
    for at, n in done.select(F.posexplode("pairs").alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n")).collect():
        pairs[at] = n
    return Model(pairs.reshape(classes, classes), once, tokens, words), done


def class_scores(df: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", classes: int = 64, frequent: int = 16_384, rounds: int = 4) -> DataFrame:
    """A row for each row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``held`` says which texts the model doesn't learn from (null: it does).  A-Z are lower-cased, words are what white space of ASCII leaves, and
    each text ends with one more token.  base_score is by add-one unigrams, score by classes, both as sums of log10; unknown words
    are one further word in both: what a class's words seen once have is kept for them.  Null texts are empty, null ids and
    repeated rows are scored like others, further columns ignored.  A text is in one task as a whole, in memory.
    """

    def make() -> DataFrame:
        model, chunks = fit(df, held, doc_id, text, classes, frequent, rounds)
        sent = df.sparkSession.sparkContext.broadcast(model)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for row in rows_of(batches):
                own, n = (np.frombuffer(row[c].as_buffer(), k).astype(np.int64) for c, k in (("class", np.int16), ("n", np.int64)))
                ends = row["ends"].values.to_numpy()
                known, base, by_class = model.scores(own, n, np.frombuffer(row["tokens"].as_buffer(), "<u4"), ends)
                size = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, row["held"].values, pa.array(size), pa.array(known), pa.array(np.full(len(size), model.tokens)), pa.array(base), pa.array(by_class), pa.array(10 ** (-by_class / size))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

        return chunks.select("doc_ids", "held", "ends", "tokens", "class", "n").mapInArrow(
            score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
        )

    return concluded(make, BATCH)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of an id's decimal digits is 2 modulo 7."""
    return F.crc32(F.col(doc_id).cast("string")) % 7 == 2
