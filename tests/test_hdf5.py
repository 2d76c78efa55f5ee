"""Containers written here byte by byte from the published format, and point-spread functions read from them."""

import struct
import zlib

import numpy as np
import pytest

from phaselens.operators import psf
from phaselens.sources import files, hdf5
from phaselens.sources import fixtures as fx

BASE = 512


class File:
    """Pieces of a container behind a user block, at addresses from its base."""

    def __init__(self):
        self.raw = bytearray(96)

    def put(self, data):
        self.raw += bytes(-len(self.raw) % 8)
        self.raw += data
        return len(self.raw) - len(data)

    def whole(self):
        return b"MATLAB 7.3 MAT-file".ljust(BASE) + bytes(self.raw)


def space(shape):
    return struct.pack("<BBBx4x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


def kind(dtype):
    return struct.pack("<BBBBI", 0x11 if dtype.kind == "f" else 0x10, 0 if dtype.byteorder != ">" else 1, 8 if dtype.kind == "i" else 0, 0, dtype.itemsize) + bytes(16 if dtype.kind == "f" else 8)


def header(file, messages, split=False):
    """A header of version 1; with ``split`` its last message is in a continuation."""
    pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + bytes(-len(d) % 8) for k, d in ms)
    if split:
        rest = pack(messages[-1:])
        messages = [*messages[:-1], (0x10, struct.pack("<QQ", file.put(rest), len(rest)))]
    body = pack(messages)
    return file.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)


def contiguous(file, array):
    at = file.put(array.tobytes())
    return header(file, [(1, space(array.shape)), (3, kind(array.dtype)), (8, struct.pack("<BBQQ", 3, 1, at, array.nbytes))], split=True)


def tree(file, keys, children, level, rank):
    body = b"".join(k + struct.pack("<Q", c) for k, c in zip(keys, children, strict=False)) + keys[-1]
    return file.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(children), hdf5.NOWHERE, hdf5.NOWHERE) + body)


def chunked(file, array, chunk, each=3):
    """Shuffled and deflated chunks, ``each`` of them in a leaf of the index; one of them isn't deflated."""
    rank, rows = array.ndim, []
    for start in np.ndindex(*(-(-n // c) for n, c in zip(array.shape, chunk, strict=True))):
        start = tuple(s * c for s, c in zip(start, chunk, strict=True))
        part = np.zeros(chunk, array.dtype)
        here = array[tuple(slice(s, s + c) for s, c in zip(start, chunk, strict=True))]
        part[tuple(slice(0, n) for n in here.shape)] = here
        raw, mask = np.frombuffer(part.tobytes(), np.uint8).reshape(-1, array.itemsize).T.tobytes(), 2 if not rows else 0
        raw = raw if mask else zlib.compress(raw)
        rows.append((struct.pack("<II", len(raw), mask) + struct.pack(f"<{rank + 1}Q", *start, 0), file.put(raw)))
    end = struct.pack("<II", 0, 0) + struct.pack(f"<{rank + 1}Q", *array.shape, 0)
    leaves = [rows[k : k + each] for k in range(0, len(rows), each)]
    nodes = [(own[0][0], tree(file, [k for k, _ in own] + [leaves[i + 1][0][0] if i + 1 < len(leaves) else end], [a for _, a in own], 0, rank)) for i, own in enumerate(leaves)]
    top = tree(file, [k for k, _ in nodes] + [end], [a for _, a in nodes], 1, rank)
    filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHH", 2, 8, 1, 1) + b"shuffle\0" + struct.pack("<I4x", array.itemsize) + struct.pack("<HHHH", 1, 8, 1, 1) + b"deflate\0" + struct.pack("<I4x", 6)
    layout = struct.pack("<BBBQ", 3, 2, rank + 1, top) + struct.pack(f"<{rank + 1}I", *chunk, array.itemsize)
    return header(file, [(1, space(array.shape)), (3, kind(array.dtype)), (0x0B, filters), (8, layout)])


def old_file(datasets):
    """Superblock 0, and a root group with a symbol table; ``datasets`` makes each and gives its header's address."""
    file = File()
    names = {n: make(file) for n, make in sorted(datasets.items())}
    text, entries = bytes(8), b""
    for n, address in names.items():
        entries += struct.pack("<QQII16x", len(text), address, 0, 0)
        text += n.encode() + b"\0" + bytes(-(len(n) + 1) % 8)
    heap = file.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), 1, file.put(text)))
    leaf = file.put(b"SNOD" + struct.pack("<BxH", 1, len(names)) + entries)
    group = file.put(b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE, 0, leaf, len(text)))
    root = header(file, [(0x11, struct.pack("<QQ", group, heap))])
    file.raw[:96] = (hdf5.SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", BASE, hdf5.NOWHERE, len(file.raw), hdf5.NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)).ljust(96, b"\0")
    return file.whole()


def new_file(arrays):
    """Superblock 2, headers of version 2, links in the root's header and one of them in its continuation."""
    file = File()

    def object_(messages, last=None):
        pack = lambda ms: b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in ms)
        body = pack(messages)
        if last:
            rest = b"OCHK" + pack([last]) + bytes(4)
            body += pack([(0x10, struct.pack("<QQ", file.put(rest), len(rest)))])
        return file.put(b"OHDR" + struct.pack("<BBH", 2, 1, len(body)) + body + bytes(4))

    def dataset(a):
        return object_([(1, struct.pack("<BBBB", 2, a.ndim, 0, 1) + struct.pack(f"<{a.ndim}Q", *a.shape)), (3, kind(a.dtype)), (8, struct.pack("<BBQQ", 3, 1, file.put(a.tobytes()), a.nbytes))])

    links = [(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", dataset(a))) for n, a in arrays.items()]
    root = object_(links[:-1], links[-1])
    file.raw[:48] = hdf5.SIGNATURE + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<QQQQ", BASE, hdf5.NOWHERE, len(file.raw), root) + bytes(4)
    return file.whole()


@pytest.fixture(scope="module")
def stored():
    r = np.random.default_rng(2)
    h = (r.random((6, 2, 2, 9, 9)) * (r.random((6, 2, 2, 9, 9)) < 0.3)).astype("<f4")
    window = np.array([[1, 2, 3, 3, 1, 2], [9, 8, 7, 7, 9, 8]], "<f8")
    return h, window


def expected(h, window, first, last, n=3):
    out = []
    for z, b, a, y, x in np.argwhere(h):
        if first <= z <= last and all(window[0, z] <= c + 1 <= window[1, z] for c in (y, x)):
            out.append((z - first, b, a, y - 4 - (b - 1), x - 4 - (a - 1), float(h[z, b, a, y, x])))
    return sorted(tuple(map(float, t)) for t in out)


@pytest.mark.parametrize("form", ["chunks", "turned", "plain", "new"])
@pytest.mark.parametrize("planes", [(0, None), (2, 3)])
def test_planes_of_a_container(spark, tmp_path, monkeypatch, stored, form, planes):
    monkeypatch.setattr(hdf5, "PIECE", 300)
    h, window = stored
    number, seen = np.array([[3.0]], "<f8"), window.T.copy() if form == "turned" else window
    if form == "new":
        raw = new_file({"H": h, "CAindex": seen, "Nnum": number})
    else:
        raw = old_file({
            "H": (lambda f: contiguous(f, h)) if form == "plain" else (lambda f: chunked(f, h, (2, 1, 2, 5, 4))), "CAindex": lambda f: contiguous(f, seen), "Nnum": lambda f: contiguous(f, number), "Ht": lambda f: contiguous(f, number),
        })
    (tmp_path / "psf.mat").write_bytes(raw)
    taps, meta, n = hdf5.read_psf_file(spark, str(tmp_path / "psf.mat"), *planes)
    first, last = planes[0], 5 if planes[1] is None else planes[0] + planes[1] - 1
    assert n == 3 and sorted(tuple(map(float, t)) for t in taps.collect()) == expected(h, window, first, last)
    assert sorted(map(tuple, meta.collect())) == [(z - first, 9, int(window[0, z]), int(window[1, z])) for z in range(first, last + 1)]


def test_a_container_serves_as_a_point_spread_function(spark, tmp_path):
    whole = fx.psf(spark, 3, 3, 2)
    h = np.zeros((2, 2, 2, 11, 11), "<f4")
    for z, b, a, dv, du, v in psf.quadrant(whole, 3).collect():
        h[z, b, a, dv + 5 + b - 1, du + 5 + a - 1] = v
    window = np.array([[1, 1], [11, 11]], "<f8")
    raw = old_file({"H": lambda f: chunked(f, h, (1, 2, 2, 11, 11)), "CAindex": lambda f: contiguous(f, window), "Nnum": lambda f: contiguous(f, np.array([[3.0]]))})
    path = tmp_path / "fdnormPSFmatrix_M40NA0.95MLPitch150fml3000from-1to0zspacing1Nnum3lambda520n1.mat"
    path.write_bytes(raw)
    taps, meta, optics = files.load_psf(spark, str(path))
    assert sorted(map(tuple, taps.collect())) == sorted(map(tuple, whole.collect())) and meta.count() == 2
    assert (optics.first()["nnum"], optics.first()["m"]) == (3, 40.0)
    one, _, _ = files.load_psf(spark, str(path), 1, 1)
    assert sorted(map(tuple, one.collect())) == sorted((0, *t[1:]) for t in map(tuple, whole.where("z = 1").collect()))


def test_only_the_index_and_chunks_of_wanted_planes_are_read(stored):
    h, _ = stored
    raw = old_file({"H": lambda f: chunked(f, h, (1, 1, 2, 5, 4), 2)})
    held = hdf5.Container(lambda at, n: raw[at : at + n])
    of = held.dataset(held.names()["H"])
    assert np.array_equal(held.array(of), h)
    whole, held.nodes = held.nodes, 0
    some = list(held.chunks(of, 3, 3))
    assert {s[0][0] for s in some} == {3} and len(some) == 2 * 1 * 2 * 3 and held.nodes < whole / 4


def test_big_endian_whole_numbers_and_empty_arrays():
    a = np.arange(12, dtype=">i2").reshape(3, 4)
    raw = old_file({"a": lambda f: contiguous(f, a), "none": lambda f: header(f, [(1, space((2, 2))), (3, kind(np.dtype("<f8"))), (8, struct.pack("<BBQQ", 3, 1, hdf5.NOWHERE, 0))])})
    held = hdf5.Container(lambda at, n: raw[at : at + n])
    names = held.names()
    assert np.array_equal(held.array(held.dataset(names["a"])), a) and not held.array(held.dataset(names["none"])).any()


def test_what_isnt_read_is_said(spark, tmp_path, stored):
    with pytest.raises(ValueError, match="no HDF5"):
        hdf5.Container(lambda at, n: bytes(5000)[at : at + n])
    (tmp_path / "x.mat").write_bytes(old_file({"H": lambda f: contiguous(f, stored[0])}))
    with pytest.raises(ValueError, match="CAindex, Nnum"):
        hdf5.read_psf_file(spark, str(tmp_path / "x.mat"))
    with pytest.raises(ValueError, match="filter"):
        hdf5.unpacked(b"", hdf5.Dataset((1,), np.dtype("<f4"), chunk=(1,), filters=[(32001, [])]))
