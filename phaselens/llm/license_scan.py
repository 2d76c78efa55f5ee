"""Licence notices in texts, whole or with a few errors.

A notice with at most e errors is cut into e + 1 seeds: by the pigeonhole principle one of them stands in the
text unchanged.  Exact seeds locate the words where a notice can begin, and there the regex library's bounded-error
matching finds it and counts its errors.  Texts are compared as words (a-z, 0-9 and all beyond ASCII) with one space between.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.llm.runtime import slices

#: Lower-cases A-Z and turns what parts words into spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """Words of a notice, its label, how many errors (characters added, lost or changed) it may have, and whether its exact places are base ones."""

    words: str
    label: str
    errors: int
    base: bool = False


#: The query's phrases and labels, exact places of which always count; each with a few errors by the method.
BASE = [Notice("cc by", "cc-by", 0, True), Notice("general public license", "gpl", 2, True), Notice("all rights reserved", "reserved", 2, True)]
#: The method's own notices.
OWN = [
    Notice("licensed under the apache license version 2 0", "apache-2.0", 4),
    Notice("licensed under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("licensed under cc by nc", "cc-by-nc", 2),
    Notice("licensed under cc by sa", "cc-by-sa", 0),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("creative commons attribution", "cc-by", 2),
]


def seeds(notice: Notice) -> list[bytes]:
    """The notice in errors + 1 parts of about equal length."""
    text, n = notice.words.encode(), notice.errors + 1
    cut = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    """Finds notices in raw UTF-8 texts."""

    def __init__(self, notices: list[Notice]):
        self.notices = [(n, seeds(n), regex.compile(rb"(?b)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(n.words.encode()), n.errors)) if n.errors else None) for n in notices]

    def scan(self, raw: bytes) -> tuple[int, list[tuple[str, str, int, int, int]]]:
        """Number of words, and (label, notice, first word, words, errors) of each place found, exact places first."""
        words = raw.translate(FOLD).split()
        text = b" " + b" ".join(words) + b" "
        found, begins = [], []

        def word_at(at: int) -> int:
            """The number of the word that begins at a byte of ``text`` or, within a word, of the next one."""
            if not begins:
                begins.extend(accumulate((len(w) + 1 for w in words[:-1]), initial=1))
            return bisect_left(begins, at)

        for notice, parts, fuzzy in self.notices:
            phrase, exact = b" " + notice.words.encode() + b" ", set()
            at = text.find(phrase)
            while at >= 0:
                exact.add(at + 1)
                found.append((notice.label, notice.words, word_at(at + 1), notice.words.count(" ") + 1, 0))
                at = text.find(phrase, at + 1)
            if not fuzzy:
                continue
            # a match begins at a word that is as far before an unchanged seed as in the notice, give or take the errors
            starts, before = set(), 0
            for part in parts:
                at = text.find(part)
                while at >= 0:
                    for start in range(max(1, at - before - notice.errors), at - before + notice.errors + 1):
                        if text[start - 1] == 32:
                            starts.add(start)
                    at = text.find(part, at + 1)
                before += len(part)
            # the best match first, then the best beside it, and so on; a start that reaches into a better one gets its best before that
            taken, most = sorted((e, e + len(notice.words)) for e in exact), len(notice.words) + notice.errors
            heap = [(sum(m.fuzzy_counts), start, m.end()) for start in starts if (m := fuzzy.match(text, start, start + most + 1))]
            heapq.heapify(heap)
            places = []
            while heap:
                errors, start, end = heapq.heappop(heap)
                k = bisect_right(taken, (start, len(text)))
                if k and taken[k - 1][1] > start:
                    continue
                if k < len(taken) and taken[k][0] < end:
                    if m := fuzzy.match(text, start, taken[k][0]):
                        heapq.heappush(heap, (sum(m.fuzzy_counts), start, m.end()))
                    continue
                insort(taken, (start, end))
                places.append((start, end, errors))
            for start, end, errors in sorted(places):
                found.append((notice.label, notice.words, word_at(start), text.count(b" ", start, end) + 1, errors))
        return len(words), found


def scan_licenses(df: DataFrame, notices: list[Notice], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, spans (label, notice, first_word, n_words, errors), in the order found.

    Null and empty texts have no words and no spans; repeated rows are each scanned; further columns are ignored.
    """
    span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int64())])
    names = [f.name for f in span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(notices)
        for b in slices(batches, "_text"):
            got = [own.scan(t or b"") for t in b.column("_text").to_pylist()]
            spans = pa.array([[dict(zip(names, s, strict=True)) for s in spans] for _, spans in got], pa.list_(span))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), spans], names=["doc_id", "n_words", "spans"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(
        run, "doc_id long, n_words long, spans array<struct<label string, notice string, first_word long, n_words long, errors long>>"
    )


def license_labels(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of a scan for the base phrases and the method's own notices.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, and score: the best share of a notice that stood
    unchanged (1 for an exact place, 0 for none).
    """
    scanned = scan_licenses(df, BASE + OWN, doc_id, text)
    names = F.array(*(F.lit(n.words) for n in BASE))
    base = F.filter("spans", lambda s: (s["errors"] == 0) & F.array_contains(names, s["notice"]))
    share = F.array_max(F.transform("spans", lambda s: 1 - s["errors"] / F.length(s["notice"])))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.withColumn("_base", base).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda s: s["first_word"])).alias("last_word"),
        labels("_base").alias("base_labels"), labels("spans").alias("labels"), F.coalesce(share, F.lit(0.0)).alias("score"),
    )
