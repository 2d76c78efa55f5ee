"""Exact subword encoding of the merge type, by backtracking over longest matches, and decoding.

The encoder never runs merges over a text.  It takes the longest vocabulary match at a position (an
Aho-Corasick automaton gives them all in one pass), keeps it only if it can stand beside its left
neighbour, and otherwise tries the next shorter one; a position from which no token leads on is
marked in a bitfield and never tried again.  Two tokens can stand side by side exactly when merging
the characters of both anew gives those two tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaselens.llm.runtime import slices

SPACE = "▁"
NORMAL, BYTE = "normal", "byte"
#: Entries of each of a worker's two generations of cached words; a full one ages and the older goes, which changes speed only.
CACHE_WORDS = 250_000



class PieceCodec:
    """Encoder and decoder for one sentencepiece model of type BPE with byte fallback and no normalisation rules."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        usable = [i for i in range(len(self.pieces)) if i not in self.id_byte and i not in self.special and not model.is_unused(i)]
        self.id_of = {self.pieces[i]: i for i in usable}
        self.score = {i: model.get_score(i) for i in usable}
        self.known = set("".join(self.id_of))
        loose = [c for c in self.known if c not in self.id_of]
        if loose:
            raise ValueError(f"characters without a piece of their own: {loose[:5]}")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        # No piece goes on from another character into a space, nor from an ASCII letter into certain
        # marks: cut there, words of a text can be encoded one by one.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("pieces cross spaces")
        lone = "" if "\n" in self.known else r"\n"
        joined = {b for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a.isascii() and a.isalpha()}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        letters = rf" *[A-Za-z]+(?![^ {lone}{marks}])|" if marks else ""
        self.words = re.compile((rf"{letters} +[^ {lone}]*|[^ {lone}]+|\n").encode("latin-1"))
        self._young: dict[bytes, tuple[int, str, bytes]] = {}
        self._old: dict[bytes, tuple[int, str, bytes]] = {}

    def merge(self, text: str) -> list[int]:
        """The definition: join the best-scored adjacent pair, the leftmost among equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                return [self.id_of[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _next_shorter(self, token: int) -> int:
        """The longest piece that begins the piece and is shorter; -1 if none."""
        found = self._shorter.get(token)
        if found is None:
            piece = self.pieces[token]
            found = self._shorter[token] = next((self.id_of[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.id_of), -1)
        return found

    def _fits(self, left: int, token: int) -> bool:
        """Whether merging anew keeps ``token`` as one, and ``left`` beside it."""
        if left < 0:
            ok = self._whole.get(token)
            if ok is None:
                ok = self._whole[token] = self.merge(self.pieces[token]) == [token]
            return ok
        ok = self._beside.get((left, token))
        if ok is None:
            if len(self._beside) > 4 * CACHE_WORDS:
                self._beside.clear()
            ok = self._beside[left, token] = self.merge(self.pieces[left] + self.pieces[token]) == [left, token]
        return ok

    def _backtrack(self, text: str) -> list[int]:
        """Encode characters that all have pieces."""
        n = len(text)
        longest = [(0, -1)] * n
        for end, (size, token) in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start][0]:
                longest[start] = (size, token)
        failed, out, at, token = 0, [], 0, longest[0][1]
        while at < n:
            left = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.pieces[token])
                if not failed >> end & 1 and self._fits(left, token):
                    break
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at][1] if at < n else -1
            else:
                if not out:
                    raise ValueError("no encoding")
                failed |= 1 << at
                token = out.pop()
                at -= len(self.pieces[token])
                token = self._next_shorter(token)
        return out

    def encode_word(self, word: str) -> list[int]:
        """Encode characters that hold spaces at their start only (as the space mark)."""
        out: list[int] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.known:
                if i > start:
                    out += self._backtrack(word[start:i])
                out += [self.byte_id[b] for b in c.encode()]
                start = i + 1
        if start < len(word):
            out += self._backtrack(word[start:] if start else word)
        return out

    def _word(self, raw: bytes) -> tuple[int, str, bytes]:
        found = self._old.get(raw)
        if not found:
            ids = self.encode_word(raw.decode().replace(" ", SPACE))
            found = (len(ids), ",".join(map(str, ids)), self._surface(ids))
        if len(self._young) >= CACHE_WORDS:
            self._old, self._young = self._young, {}
        self._young[raw] = found
        return found

    def _split(self, text: bytes) -> list[bytes]:
        return self.words.findall(b" " + text.replace(SPACE.encode(), b" ")) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin and end ids; [] for an empty one."""
        return [i for w in self._split(text.encode()) for i in self.encode_word(w.decode().replace(" ", SPACE))]

    def _surface(self, ids: list[int]) -> bytes:
        """Bytes of the ids, space marks as spaces."""
        out, run = bytearray(), bytearray()
        for i in [*ids, -1]:
            if i in self.id_byte:
                run.append(self.id_byte[i])
                continue
            if run:
                out += run.decode(errors="replace").encode()
                run.clear()
            if i >= 0 and i not in self.special:
                out += self.pieces[i].replace(SPACE, " ").encode()
        return bytes(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space that encoding put before it is taken off, bytes that aren't UTF-8 become U+FFFD."""
        return self._surface(ids).decode().removeprefix(" ")

    def digest(self, text: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, and of the decoded text."""
        words = self._split(text)
        found = [self._young.get(w) or self._word(w) for w in words]
        ids = ",".join([f[1] for f in found])
        decoded = b"".join([f[2] for f in found]).removeprefix(b" ")
        return sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=4)
def codec(model_path: str) -> PieceCodec:
    """One codec for each model and Python worker."""
    return PieceCodec(model_path)


def encode_texts(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array column ``ids``. A null text gives an empty array. All other columns stay as they are.

    ``model_path`` must be readable on every executor.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in batches:
            made = pa.array([own.encode(t.as_py() or "") for t in b.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), made], names=schema.names)

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the string column ``text`` with the decoded ids; null ids give an empty text."""
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in batches:
            made = pa.array([own.decode(t.as_py() or []) for t in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), made], names=schema.names)

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Words of a text are encoded once per worker while they stay in its cache.  Null and empty texts have
    no ids; repeated rows are each answered; further columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in slices(batches, "_text"):
            rows = [own.digest(t.as_py() or b"") for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
