"""Point-spread functions in HDF5 containers (as MATLAB 7.3 files are), read by byte ranges.

Written from the published HDF5 file format: superblocks 0 to 3, object headers 1 and 2, groups by symbol tables or by links in
the header, whole numbers and floats, contiguous, compact and chunked data with shuffled and deflated chunks.  The driver reads
what says where chunks lie, following only those branches of the index that hold wanted planes; chunks themselves are rows,
each read and unpacked by the task that has it, and give taps.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Bytes of a piece of contiguous data that is a row of its own.
PIECE = 4_000_000


@dataclass
class Dataset:
    """Shape and type of an array, and where it lies: at an address as a whole, inline, or in chunks by an index."""

    shape: tuple[int, ...] = ()
    dtype: np.dtype | None = None
    address: int = NOWHERE
    inline: bytes | None = None
    chunk: tuple[int, ...] = ()
    filters: list[tuple[int, list[int]]] = field(default_factory=list)


class Container:
    """Names and arrays of one file, by ``read`` (offset, number of bytes)."""

    def __init__(self, read: Callable[[int, int], bytes]):
        at = 0
        while read(at, 8) != SIGNATURE:
            at = 512 if not at else 2 * at
            if at > 1 << 26 or len(read(at, 8)) < 8:
                raise ValueError("no HDF5 file")
        head = read(at, 112)
        version = head[8]
        self.read = lambda offset, n: read(self.base + offset, n)
        if version < 2:
            if head[13:15] != b"\x08\x08":
                raise ValueError("only 8-byte offsets and lengths are read")
            places = 24 + (4 if version else 0)
            (self.base,) = struct.unpack_from("<Q", head, places)
            (self.root,) = struct.unpack_from("<Q", head, places + 40)
        else:
            if head[9:11] != b"\x08\x08":
                raise ValueError("only 8-byte offsets and lengths are read")
            (self.base,) = struct.unpack_from("<Q", head, 12)
            (self.root,) = struct.unpack_from("<Q", head, 36)
        self.base = self.base or at if version < 2 else self.base
        #: Nodes of chunk indexes that were read.
        self.nodes = 0

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        """(kind, data) of an object's header, wherever it goes on."""
        start = self.read(address, 32)
        if start[:4] == b"OHDR":
            flags, at = start[5], 6
            at += (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(start[at : at + width], "little")
            blocks, prefix, form = [(address + at + width, size)], 4 + (2 if flags & 4 else 0), 2
        else:
            blocks, prefix, form = [(address + 16, struct.unpack_from("<I", start, 8)[0])], 8, 1
        while blocks:
            where, size = blocks.pop(0)
            raw, at = self.read(where, size), 0
            while at + prefix <= len(raw):
                kind, n = (struct.unpack_from("<HH", raw, at) if form == 1 else (raw[at], struct.unpack_from("<H", raw, at + 1)[0]))
                data = raw[at + prefix : at + prefix + n]
                at += prefix + n
                if kind == 0x10:
                    to, length = struct.unpack_from("<QQ", data)
                    blocks.append((to, length) if form == 1 else (to + 4, length - 8))
                elif kind:
                    yield kind, data

    def names(self) -> dict[str, int]:
        """Addresses of the objects in the root group."""
        out: dict[str, int] = {}
        for kind, data in self.messages(self.root):
            if kind == 0x11:
                tree, heap = struct.unpack_from("<QQ", data)
                (text,) = struct.unpack_from("<Q", self.read(heap, 32), 24)
                out |= dict(self._symbols(tree, text))
            elif kind == 0x06:
                out |= dict([self._link(data)])
            elif kind == 0x02 and struct.unpack_from("<Q", data, 10 if data[1] & 1 else 2)[0] != NOWHERE:
                raise ValueError("groups with links outside of their headers aren't read")
        return out

    def _symbols(self, tree: int, text: int) -> Iterator[tuple[str, int]]:
        head = self.read(tree, 24)
        if head[:4] != b"TREE":
            raise ValueError("not a group's tree")
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        raw = self.read(tree + 24, 16 * n + 8)
        for k in range(n):
            (child,) = struct.unpack_from("<Q", raw, 16 * k + 8)
            if level:
                yield from self._symbols(child, text)
                continue
            rows = self.read(child, 8)
            number = struct.unpack_from("<H", rows, 6)[0]
            entries = self.read(child + 8, 40 * number)
            for i in range(number):
                name, address = struct.unpack_from("<QQ", entries, 40 * i)
                yield self.read(text + name, 256).split(b"\0")[0].decode(), address

    @staticmethod
    def _link(data: bytes) -> tuple[str, int]:
        flags, at = data[1], 2
        kind = data[at] if flags & 8 else 0
        at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 0x10 else 0)
        width = 1 << (flags & 3)
        n = int.from_bytes(data[at : at + width], "little")
        name = data[at + width : at + width + n].decode()
        return name, struct.unpack_from("<Q", data, at + width + n)[0] if kind == 0 else NOWHERE

    def dataset(self, address: int) -> Dataset:
        out = Dataset()
        for kind, data in self.messages(address):
            if kind == 0x01:
                out.shape = struct.unpack_from(f"<{data[1]}Q", data, 8 if data[0] == 1 else 4)
            elif kind == 0x03:
                order, size = "><"[not data[1] & 1], struct.unpack_from("<I", data, 4)[0]
                sort = {0: "i" if data[1] & 8 else "u", 1: "f"}.get(data[0] & 15)
                if sort is None:
                    raise ValueError("only whole numbers and floats are read")
                out.dtype = np.dtype(f"{order}{sort}{size}")
            elif kind == 0x08:
                if data[0] != 3:
                    raise ValueError("only layouts of version 3 are read")
                if data[1] == 0:
                    out.inline = data[4 : 4 + struct.unpack_from("<H", data, 2)[0]]
                elif data[1] == 1:
                    (out.address,) = struct.unpack_from("<Q", data, 2)
                else:
                    (out.address,) = struct.unpack_from("<Q", data, 3)
                    out.chunk = struct.unpack_from(f"<{data[2] - 1}I", data, 11)
            elif kind == 0x0B:
                out.filters = self._filters(data)
        return out

    @staticmethod
    def _filters(data: bytes) -> list[tuple[int, list[int]]]:
        out, at = [], 8 if data[0] == 1 else 2
        for _ in range(data[1]):
            (which,) = struct.unpack_from("<H", data, at)
            named = data[0] == 1 or which >= 256
            length = struct.unpack_from("<H", data, at + 2)[0] if named else 0
            at += 4 if named else 2
            numbers = struct.unpack_from("<H", data, at + 2)[0]
            at += 4 + (-(-length // 8) * 8 if data[0] == 1 else length)
            out.append((which, list(struct.unpack_from(f"<{numbers}I", data, at))))
            at += 4 * numbers + (4 if data[0] == 1 and numbers % 2 else 0)
        return out

    def chunks(self, of: Dataset, first: int, last: int, tree: int | None = None) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(start, offset in the file, bytes, mask of filters left out) of the chunks that touch places first to last of the first axis."""
        tree = of.address if tree is None else tree
        if tree == NOWHERE:
            return
        self.nodes += 1
        head = self.read(tree, 24)
        level, n, rank = head[5], struct.unpack_from("<H", head, 6)[0], len(of.shape)
        width = 8 + 8 * (rank + 1)
        raw = self.read(tree + 24, n * (width + 8) + width)
        starts = [struct.unpack_from(f"<{rank}Q", raw, k * (width + 8) + 8) for k in range(n + 1)]
        for k in range(n):
            (child,) = struct.unpack_from("<Q", raw, k * (width + 8) + width)
            if level:
                # children are in the order of their starts; the next one's says how far this one goes
                if starts[k][0] <= last and (k + 1 == n or starts[k + 1][0] + of.chunk[0] > first):
                    yield from self.chunks(of, first, last, child)
            elif starts[k][0] <= last and starts[k][0] + of.chunk[0] > first:
                size, mask = struct.unpack_from("<II", raw, k * (width + 8))
                yield starts[k], self.base + child, size, mask

    def array(self, of: Dataset) -> np.ndarray:
        """A small array as a whole."""
        if of.chunk:
            out = np.zeros(of.shape, of.dtype)
            for start, offset, size, mask in self.chunks(of, 0, of.shape[0]):
                part = unpacked(self.read(offset - self.base, size), of, mask)
                here = tuple(slice(s, min(s + c, n)) for s, c, n in zip(start, of.chunk, of.shape, strict=True))
                out[here] = part[tuple(slice(0, h.stop - h.start) for h in here)]
            return out
        raw = of.inline if of.inline is not None else self.read(of.address, int(np.prod(of.shape)) * of.dtype.itemsize) if of.address != NOWHERE else bytes(int(np.prod(of.shape)) * of.dtype.itemsize)
        return np.frombuffer(raw, of.dtype, int(np.prod(of.shape))).reshape(of.shape)


def unpacked(raw: bytes, of: Dataset, mask: int = 0) -> np.ndarray:
    """A chunk's values: filters are undone from the last to the first, but for those in the mask."""
    for k in range(len(of.filters) - 1, -1, -1):
        which, numbers = of.filters[k]
        if mask >> k & 1:
            continue
        if which == 1:
            raw = zlib.decompress(raw)
        elif which == 2:
            size = numbers[0] if numbers else of.dtype.itemsize
            raw = np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes()
        elif which == 3:
            raw = raw[:-4]  # a checksum
        else:
            raise ValueError(f"filter {which} isn't known")
    return np.frombuffer(raw, of.dtype).reshape(of.chunk)


def opened(path: str) -> tuple[Callable[[int, int], bytes], object]:
    system, place = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    file = system.open_input_file(place)

    def read(offset: int, n: int) -> bytes:
        return file.read_at(max(0, min(n, file.size() - offset)), offset) if offset < file.size() else b""

    return read, file


def read_psf_file(spark: SparkSession, path: str, first: int = 0, number: int | None = None, name: str = "H") -> tuple[DataFrame, DataFrame, int]:
    """Taps (z, b, a, dv, du, h) of a stored quadrant of phases, its catalogue (z, s, ca_lo, ca_hi), and the number of pixels of a lenslet.

    Only chunks of the planes from ``first`` on, ``number`` of them, are read; planes are renumbered from 0.  The array is (plane, phase, phase, rows,
    columns); taps that are 0 or outside of a plane's window (CAindex, either way round) aren't there.  ``psf.expand`` gives the other phases.
    """
    read, file = opened(path)
    with file:
        held = Container(read)
        names = held.names()
        missing = [n for n in (name, "CAindex", "Nnum") if n not in names]
        if missing:
            raise ValueError(f"{path} has no {', '.join(missing)}")
        n = int(held.array(held.dataset(names["Nnum"])).ravel()[0])
        window = held.array(held.dataset(names["CAindex"])).astype(int)
        window = window.T if window.shape[1] == 2 and window.shape[0] != 2 else window
        of = held.dataset(names[name])
        if len(of.shape) != 5:
            raise ValueError(f"{name} must have five axes")
        last = of.shape[0] - 1 if number is None else min(of.shape[0], first + number) - 1
        if of.chunk:
            rows = [(list(map(int, start)), list(of.chunk), offset, size, mask) for start, offset, size, mask in held.chunks(of, first, last)]
        else:
            plane = of.shape[3] * of.shape[4]
            step = max(1, min(of.shape[2], PIECE // (plane * of.dtype.itemsize)))
            rows = [
                ([z, b, a, 0, 0], [1, 1, min(step, of.shape[2] - a), *of.shape[3:]], held.base + of.address + ((z * of.shape[1] + b) * of.shape[2] + a) * plane * of.dtype.itemsize, min(step, of.shape[2] - a) * plane * of.dtype.itemsize, 0)
                for z in range(first, last + 1) for b in range(of.shape[1]) for a in range(0, of.shape[2], step)
            ] if of.address != NOWHERE else []
    middle, ends, half = (of.shape[3] - 1) // 2, window[:, : of.shape[0]].tolist(), (n - 1) // 2
    plain = Dataset(of.shape, of.dtype, chunk=of.chunk, filters=of.filters)

    def taps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, own = None, None
        for batch in batches:
            if source is None:
                source, own = opened(path)
            for r in batch.to_pylist():
                raw = source(r["offset"], r["size"])
                part = unpacked(raw, Dataset(plain.shape, plain.dtype, chunk=tuple(r["shape"]), filters=plain.filters), r["mask"])
                at = np.argwhere(part)
                values = part[tuple(at.T)].astype(float)
                at = at + np.array(r["start"])
                low, high = (np.array(e)[np.minimum(at[:, 0], len(e) - 1)] for e in ends)
                kept = (at < np.array(plain.shape)).all(1) & (at[:, 0] >= first) & (at[:, 0] <= last) & (at[:, 1:3] <= half).all(1)
                kept &= ((at[:, 3:] + 1 >= low[:, None]) & (at[:, 3:] + 1 <= high[:, None])).all(1)
                at, values = at[kept], values[kept]
                columns = [at[:, 0] - first, at[:, 1], at[:, 2], at[:, 3] - middle - (at[:, 1] - half), at[:, 4] - middle - (at[:, 2] - half)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(values)], names=["z", "b", "a", "dv", "du", "h"])
        if own is not None:
            own.close()

    index = spark.createDataFrame(rows, "start array<long>, shape array<long>, offset long, size long, mask int")
    dealt = index.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))
    found = dealt.mapInArrow(taps, "z int, b int, a int, dv int, du int, h double")
    meta = spark.createDataFrame([(z - first, of.shape[3], ends[0][z], ends[1][z]) for z in range(first, last + 1)], "z int, s int, ca_lo int, ca_hi int")
    return found, meta, n
