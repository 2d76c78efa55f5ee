"""Best-fit packing of tokenised documents into sequences of fixed length, by bin completion.

Only the number of pieces of each length matters to the plan, so the search runs on a histogram of at
most ``capacity`` rows, and each decision is taken for as many sequences as its lengths last.  The plan
has one row for each length in each kind of sequence; pieces find their places in it by their rank
among the pieces of their length, which is dealt out in parallel.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaselens.llm.runtime import settle, slices

#: Pieces of one length are numbered in so many shares, or in one for each EACH pieces of all, so that a length that a third of all rows have is no hot key.
SHARES, EACH = 64, 1_000_000
CACHE_WORDS = 150_000
#: Steps towards a filling that count as one decision; the deepest levels whose place in the fillings is held, others look it up again.
STEPS, OPEN = 64, 64
#: Fillings of the least waste among which dives for a first packing look.
EVEN = (100, 400)
Pattern = tuple[tuple[int, int], ...]


@dataclass
class Level:
    """A decision of the search: where it is in the fillings, and how many sequences of which filling it takes."""

    ways: Iterator[tuple[int, Pattern] | None] | None = None
    drawn: int = 0
    lost: int = 0
    pattern: Pattern = ()
    n: int = 0


class WordTokens:
    """Ids of texts by a ``tokenizers`` file of lower-cased words whose pre-tokenizer never joins what ASCII white space separates.

    Texts whose characters beyond ASCII are Latin letters are cut into runs of letters (with an apostrophe before them),
    of digits and of other characters, which are tokenised once each while they stay in the cache; other texts are cut at
    white space only.
    """

    WORDS = re.compile(rb"'?[a-z\x80-\xff]+|[0-9]+|[^\sa-z0-9\x80-\xff]+")
    #: Characters beyond ASCII other than U+00C0 to U+027F, and of these the signs and the letter whose lower case is two characters.
    ODD = re.compile(rb"[\xc2\xca-\xff]|\xc3[\x97\xb7]|\xc4\xb0|<\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) >= CACHE_WORDS:
            aged, self.words = self.words, Words(self.tokenizer)
            aged.old = {}
            self.words.old = aged
        get, words = self.words.__getitem__, self.WORDS.findall
        return [b"".join(map(get, t.split() if self.ODD.search(t) else words(t.lower()))) for t in texts]


class Words(dict):
    """Ids of words, looked up in an older generation of itself or made where they are missing.

    A word of Latin letters only is one pre-token, which the model takes as its lower case's bytes, each as the printable
    character that byte-level vocabularies have for it.
    """

    LETTERS = re.compile(rb"(?:[a-z]|[\xc3-\xc9][\x80-\xbf])+")
    PRINTED = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    PRINTED |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not 33 <= b <= 126 and not 161 <= b <= 172 and b < 174)}

    def __init__(self, tokenizer):
        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.tokenizer, self.model = tokenizer, tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        ids = dict.get(self.old, word)
        if ids is None:
            if self.LETTERS.fullmatch(word) and not WordTokens.ODD.search(word):
                printed = word.decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(self.PRINTED)
                ids = array("I", [t.id for t in self.model(printed)])
            else:
                ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
            if sys.byteorder == "big":
                ids.byteswap()
            ids = ids.tobytes()
        self[word] = ids
        return ids


_tokens: dict[str, WordTokens] = {}


def pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit).

    A document is its ids and then ``end_id``; only those longer than ``capacity`` are cut. Null and empty
    texts are just ``end_id``. Repeated rows give repeated pieces; further columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokens.get(tokenizer) or _tokens.setdefault(tokenizer, WordTokens(tokenizer))
        last = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for b in slices(batches, "_text"):
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), own.ids([t or b"" for t in b.column("_text").to_pylist()]), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def least_bins(lengths: dict[int, int], capacity: int) -> int:
    """A number of sequences below which no packing gets: by total, and by the lengths over half with what can't stand beside them."""
    size = np.array(sorted(lengths), np.int64)
    n = np.array([lengths[s] for s in size.tolist()], np.int64)
    best = -(-int((size * n).sum()) // capacity)
    for k in [0, *(s for s in size.tolist() if 2 * s <= capacity)]:
        alone, big = size > capacity - k, (size <= capacity - k) & (2 * size > capacity)
        small = (2 * size <= capacity) & (size >= k)
        room = int((n[big] * (capacity - size[big])).sum())
        rest = max(0, int((size * n)[small].sum()) - room)
        best = max(best, int(n[alone].sum() + n[big].sum()) - (-rest // capacity))
    return best


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on the histogram: kinds of sequence and how many of each."""
    open_: dict[int, list[list]] = {}  # room left -> [pattern, how many]
    for s in sorted(lengths, reverse=True):
        left = lengths[s]
        for room in sorted(r for r in open_ if r >= s):
            fit, groups = room // s, open_.pop(room)
            kept = []
            for pattern, n in groups:
                full = min(n, left // fit)
                if full:
                    open_.setdefault(room - fit * s, []).append([(*pattern, (s, fit)), full])
                    left -= full * fit
                part = left if full < n and left < fit else 0
                if part:
                    open_.setdefault(room - part * s, []).append([(*pattern, (s, part)), 1])
                    left = 0
                if n - full - bool(part):
                    kept.append([pattern, n - full - bool(part)])
            if kept:
                open_.setdefault(room, []).extend(kept)
            if not left:
                break
        fit = capacity // s
        if left // fit:
            open_.setdefault(capacity - fit * s, []).append([((s, fit),), left // fit])
        if left % fit:
            open_.setdefault(capacity - left % fit * s, []).append([((s, left % fit),), 1])
    return [(tuple(p), n) for groups in open_.values() for p, n in groups]


def _wider(bits: int, by: int) -> int:
    """Bits and the ``by`` places above each."""
    have = 1
    while have <= by:
        step = min(have, by + 1 - have)
        bits |= bits << step
        have += step
    return bits


def fillings(size: list[int], n: list[int], room: int, most: int) -> Iterator[tuple[int, Pattern] | None]:
    """(waste, pattern) of each undominated way to fill ``room`` from ``n`` pieces of each ``size`` (descending), the least waste first, up to ``most``.

    A filling is dominated if one of its pieces could be swapped for a longer one that is left and still fits, or several for one
    at least as long as all of them: the other then leaves no worse pieces behind.  None is a step of the search without a filling.
    """
    end, whole = len(size), (2 << room) - 1
    reach = [1] * (end + 1)  # as bits, the totals up to room that pieces of size[k:] can have
    for k in range(end - 1, -1, -1):
        bits, copies, step = reach[k + 1], min(n[k], room // size[k]), 1
        while copies > 0 and bits != whole:
            bits |= bits << min(step, copies) * size[k] & whole
            copies, step = copies - step, 2 * step
        reach[k] = whole if bits == whole else bits

    def ways(at: int, rest: int, one: int, more: int, held: int, waste: int) -> Iterator[tuple | None]:
        """Next lengths, how many of each, and the state after them; one, more, held: totals of one piece taken, of several, and lengths left, as bits."""
        better = held >> rest & (2 << waste) - 1  # one piece that could stand for all that are still to come
        for k in range(max(at, bisect_left(size, -rest, key=neg)), end):
            if not reach[k] >> rest & 1 or better > 1 or better and size[k] != rest:
                return
            s, states = size[k], []
            for copies in range(1, min(n[k], rest // s) + 1):
                _, one_, more_, _ = states[-1] if states else (0, one, more, held)
                one_, more_ = one_ | 1 << s, more_ | (more_ | one_) << s
                held_ = held if copies < n[k] else held & ~(1 << s)
                if held_ & (_wider(more_, waste) | (_wider(one_ << 1, waste - 1) if waste else 0)):
                    break
                states.append((copies, one_, more_, held_))
            yield None
            for copies, one_, more_, held_ in reversed(states):
                if reach[k + 1] >> rest - copies * s & 1:
                    yield (s, copies), (k + 1, rest - copies * s, one_, more_, held_, waste)

    held = sum(1 << s for s in size)
    for waste in range(min(most, room) + 1):
        if not reach[0] >> room - waste & 1:
            continue
        if waste == room:
            yield None if held & whole else (waste, ())
            continue
        stack, pattern = [ways(0, room - waste, 0, 0, held, waste)], []
        while stack:
            for way in stack[-1]:
                if way is None:
                    yield None
                    continue
                taken, state = way
                if state[1]:
                    pattern.append(taken)
                    stack.append(ways(*state))
                    break
                yield None if state[4] & (2 << waste) - 1 else (waste, (*pattern, taken))
            else:
                stack.pop()
                if pattern:
                    pattern.pop()


def even_dive(lengths: dict[int, int], capacity: int, look: int) -> list[tuple[Pattern, int]]:
    """A packing without ways back: around the longest length left, of the first ``look`` fillings of the least waste, always the one whose pieces are the most alike, for as many sequences as it lasts.

    So short pieces are kept for the end, where long ones alone would leave much room.
    """
    left, plan = dict(lengths), []
    while left:
        top = max(left)
        size = sorted((s for s in left if s <= capacity - top and left[s] - (s == top) > 0), reverse=True)
        best: tuple[tuple[int, int], Pattern] | None = None
        found = 0
        for steps, way in enumerate(fillings(size, [left[s] - (s == top) for s in size], capacity - top, capacity - top)):
            if way is None:
                if best and steps > 4 * look:
                    break
                continue
            if best and way[0] > best[0][0]:
                break
            found += 1
            key = (way[0], sum(s * s * k for s, k in way[1]))
            if best is None or key < best[0]:
                best = (key, way[1])
            if found == look:
                break
        pattern = _joined(top, best[1])
        n = min(left[s] // k for s, k in pattern)
        plan.append((pattern, n))
        for s, k in pattern:
            left[s] -= n * k
            if not left[s]:
                del left[s]
    return plan


def bin_completion(lengths: dict[int, int], capacity: int, nodes: int | None = 8_000) -> list[tuple[Pattern, int]]:
    """The best packing that ``search`` finds: kinds of sequence and how many of each."""
    return search(lengths, capacity, nodes)[0]


def search(lengths: dict[int, int], capacity: int, nodes: int | None = 8_000) -> tuple[list[tuple[Pattern, int]], bool]:
    """A packing, and whether it is proven that none has fewer sequences.

    Branch and bound over the undominated fillings around the longest length left, each for as many sequences as it lasts, then for fewer.

    The incumbent is the best-fit packing, or an even dive's if that has fewer sequences (dives look
    at EVEN fillings, and are made if ``nodes`` is more than that). A branch is cut as soon as its waste is more than a packing with one
    sequence less may have, or where the same pieces were left before. The search ends when an incumbent meets the lower bound,
    when all is searched, or after ``nodes`` decisions, STEPS steps towards a filling counting as one:
    only then the packing is just the best one found.  With None the search goes on until all is searched, which may take very long.
    """
    nodes = float("inf") if nodes is None else nodes
    lengths = {s: n for s, n in lengths.items() if n > 0}
    if any(not 0 < s <= capacity for s in lengths):
        raise ValueError("lengths must be from 1 to the capacity")
    whole = [(((capacity, 1),), lengths.pop(capacity))] if capacity in lengths else []
    if not lengths:
        return whole, True
    count = lambda plan: sum(n for _, n in plan)
    best, least, total = best_fit(lengths, capacity), least_bins(lengths, capacity), sum(s * n for s, n in lengths.items())
    for look in EVEN:
        if count(best) > least and nodes > look:
            best = min(best, even_dive(lengths, capacity, look), key=count)
    left = np.zeros(capacity + 1, np.int64)
    for s, n in lengths.items():
        left[s] = n
    bins, waste, steps, spent = count(best), 0, 0, 0
    levels: list[Level] = []
    seen: dict[bytes, int] = {}  # pieces left -> least waste they were left with

    def put(level: Level, n: int) -> int:
        """Take n sequences of the level's filling (back, if negative); their waste."""
        for s, k in level.pattern:
            left[s] -= n * k
        level.n += n
        return n * level.lost

    while bins > least and spent + steps // STEPS < nodes:
        may = (bins - 1) * capacity - total - waste
        if may >= 0:
            if left.any():
                key = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
                if waste < seen.get(key, waste + 1):
                    seen[key] = waste
                    levels.append(Level())
                    if len(levels) > OPEN:
                        levels[-1 - OPEN].ways = None
            else:
                best = [(level.pattern, level.n) for level in levels]
                bins = count(best)
        # the deepest level that has another way goes on: one sequence less, or else another filling
        while levels and spent + steps // STEPS < nodes:
            level, n = levels[-1], max(0, levels[-1].n - 1)
            waste += put(level, -level.n)
            may = (bins - 1) * capacity - total - waste
            if not n:
                top = int(np.flatnonzero(left)[-1])
                if level.ways is None:
                    left[top] -= 1
                    size = np.flatnonzero(left[: capacity - top + 1])[::-1]
                    level.ways = islice(fillings(size.tolist(), left[size].tolist(), capacity - top, may), level.drawn, None)
                    left[top] += 1
                found = None
                for found in level.ways:
                    level.drawn += 1
                    if found or spent + steps // STEPS >= nodes:
                        break
                    steps += 1
                if not found or found[0] > may:
                    levels.pop()
                    continue
                level.lost, level.pattern = found[0], _joined(top, found[1])
                n = int(min(left[s] // k for s, k in level.pattern))
            if level.lost:
                n = min(n, may // level.lost)
            if n > 0:
                waste += put(level, n)
                spent += 1
                break
        else:
            break
    return whole + best, bins <= least or (not levels and spent + steps // STEPS < nodes)


def _joined(top: int, rest: Pattern) -> Pattern:
    return ((top, rest[0][1] + 1), *rest[1:]) if rest and rest[0][0] == top else ((top, 1), *rest)


def pack(cut: DataFrame, capacity: int = 4096, nodes: int | None = 8_000) -> DataFrame:
    """Add sequence_id, offset (both long) and proven (whether no packing has fewer sequences) to pieces with a length from 1 to ``capacity`` each.

    Places are gapless from 0. Equal rows are told apart by rank, so each gets a place of its own; which of several pieces of one length
    gets which place goes by doc_id and piece.  Other columns are kept, whatever their names; those named like the new ones are
    replaced. An empty table stays empty.
    """
    cut = cut.drop("sequence_id", "offset", "proven")
    fresh = lambda name: name if name not in cut.columns else fresh(f"_{name}")
    share_, n_, before_, rank_ = (fresh(name) for name in ("_share", "_n", "_before", "_rank"))
    kept = cut.columns
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(SHARES, cut.count() // EACH)))
    cut = cut.withColumn(share_, share)
    counts = settle(cut.groupBy("length", share_).agg(F.count("*").alias(n_)))
    plan, proven = search({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(n_).alias("n")).collect()}, capacity, nodes)
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, n in plan:
        offset = 0
        for s, k in pattern:
            places.setdefault(s, []).append((used.get(s, 0), first, k, offset))
            used[s] = used.get(s, 0) + k * n
            offset += s * k
        first += n
    table = {s: np.array(rows, np.int64).T for s, rows in places.items()}
    before = counts.withColumn(before_, F.sum(n_).over(Window.partitionBy("length").orderBy(share_).rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("length", share_).orderBy("doc_id", "piece")) - 1
    ranked = cut.join(before.select("length", share_, F.coalesce(before_, F.lit(0)).alias(before_)), ["length", share_]).withColumn(rank_, rank + F.col(before_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column(rank_).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                own = np.flatnonzero(length == s)
                start, base, k, off = table[s]
                at = np.searchsorted(start, rank[own], "right") - 1
                step = rank[own] - start[at]
                sequence[own] = base[at] + step // k[at]
                offset[own] = off[at] + step % k[at] * s
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != share_)
    return ranked.select(*kept, rank_).mapInArrow(run, f"{schema}, sequence_id long, offset long").withColumn("proven", F.lit(proven))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, nodes: int | None = 8_000) -> DataFrame:
    """Tokenise, cut and pack documents; see ``pieces`` and ``pack``. ``nodes`` bounds the search for fewer sequences, None searches all."""
    return pack(settle(pieces(df, tokenizer, capacity, end_id, doc_id, text, with_ids)), capacity, nodes)
