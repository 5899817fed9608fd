"""Records of shapefiles and of their attribute tables as Arrow columns, many at a time.

Everything here works on the bytes of a range of records: NumPy gathers the fields at their offsets, and coordinates,
parts and cells become Arrow lists without an object per record or point.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The shape types of the format, with and without heights.
POINTS, LINES, POLYGONS, WITH_Z = (1, 11, 21), (3, 13, 23), (5, 15, 25), (11, 13, 15)
#: Bytes of the main file's and the index file's header, and of an index entry.
HEADER, ENTRY = 100, 8

POINT = pa.struct([(c, pa.float64()) for c in "xyz"])
PARTS = pa.list_(pa.list_(POINT))
REPLACED = "text-utf8-decode-replacement"
MISMATCH = "text-utf8-dbf-row-mismatch"
#: Half-width katakana, which Korean texts show when they are read in the wrong encoding.
_HALF_WIDTH = "[｡-ﾟ]"


def spread(start: np.ndarray, n: np.ndarray, step: int = 1) -> np.ndarray:
    """start, start + step, ... n times, one range after another."""
    n = np.asarray(n, dtype=np.int64)
    before = np.cumsum(n) - n
    return np.repeat(np.asarray(start, dtype=np.int64), n) + step * (np.arange(int(n.sum())) - np.repeat(before, n))


def index_entries(shx: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each record, bytes of its content) from entries of an index file."""
    words = np.frombuffer(shx[: len(shx) // ENTRY * ENTRY], dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
    return words[:, 0], words[:, 1]


def walked(shp: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same for a file without an index, from one record to the next."""
    offsets, lengths, at = [], [], HEADER
    while at + 12 <= len(shp):
        n = 2 * int.from_bytes(shp[at + 4 : at + 8], "big", signed=True)
        if n < 4:
            break
        offsets.append(at)
        lengths.append(n)
        at += 8 + n
    return np.array(offsets, dtype=np.int64), np.array(lengths, dtype=np.int64)


def _read(buf: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Numbers at any byte offsets."""
    width = np.dtype(kind).itemsize
    return buf[at[:, None] + np.arange(width)].reshape(-1).view(kind) if len(at) else np.zeros(0, dtype=kind)


def shapes(raw: bytes, offsets: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(kind, parts) of the records at the offsets. A null kind stands for a missing, an unknown or a damaged shape."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    n = len(offsets)
    body = np.asarray(offsets, dtype=np.int64) + 8
    whole = (body >= 8) & (lengths >= 4) & (body + lengths <= len(buf))
    code = np.zeros(n, dtype=np.int64)
    code[whole] = _read(buf, body[whole], "<i4")
    is_point = np.isin(code, POINTS) & (lengths >= 20)
    n_parts, n_points = is_point.astype(np.int64), is_point.astype(np.int64)
    path = np.flatnonzero((np.isin(code, LINES) | np.isin(code, POLYGONS)) & (lengths >= 44))
    p, m = _read(buf, body[path] + 36, "<i4").astype(np.int64), _read(buf, body[path] + 40, "<i4").astype(np.int64)
    fits = (p >= 0) & (m >= 0) & (44 + 4 * p + 16 * m <= lengths[path])
    path, p, m = path[fits], p[fits], m[fits]
    first = _read(buf, spread(body[path] + 44, p, 4), "<i4").astype(np.int64)
    # parts start at 0 and ascend, or the shape is damaged
    owner = np.repeat(np.arange(len(path)), p)
    edge = np.cumsum(p) - p
    last = np.append(first[1:], 0) if len(first) else first
    ends = edge[p > 0] + p[p > 0] - 1
    last[ends] = m[p > 0]
    odd = (last < first) | (first < 0)
    odd[edge[p > 0]] |= first[edge[p > 0]] != 0
    sound = np.bincount(owner[odd], minlength=len(path)) == 0
    keep = sound[owner]
    size, owner = (last - first)[keep], owner[keep]
    # parts without points are no parts
    size, owner = size[size > 0], owner[size > 0]
    n_parts[path[sound]] = np.bincount(owner, minlength=len(path))[sound]
    path, p, m = path[sound], p[sound], m[sound]
    n_points[path] = m * (n_parts[path] > 0)
    m = n_points[path]
    begin = np.cumsum(n_points) - n_points
    xyz = np.zeros((3, int(n_points.sum())))
    ones = np.flatnonzero(is_point)
    for axis in range(2):
        xyz[axis, begin[ones]] = _read(buf, body[ones] + 4 + 8 * axis, "<f8")
    high = ones[(code[ones] == 11) & (lengths[ones] >= 28)]
    xyz[2, begin[high]] = _read(buf, body[high] + 20, "<f8")
    at = body[path] + 44 + 4 * p
    place = spread(begin[path], m)
    both = _read(buf, spread(at, 2 * m, 8), "<f8")
    xyz[0, place], xyz[1, place] = both[0::2], both[1::2]
    z_at = at + 16 * m + 16
    high = np.isin(code[path], WITH_Z) & (z_at + 8 * m <= body[path] + lengths[path])
    xyz[2, spread(begin[path[high]], m[high])] = _read(buf, spread(z_at[high], m[high], 8), "<f8")
    part_size = np.ones(int(n_parts.sum()), dtype=np.int64)
    part_size[spread((np.cumsum(n_parts) - n_parts)[path], n_parts[path])] = size
    points = pa.StructArray.from_arrays([pa.array(a) for a in xyz], names=list("xyz"))
    parts = pa.ListArray.from_arrays(_offsets(n_parts), pa.ListArray.from_arrays(_offsets(part_size), points))
    kinds = np.zeros(n, dtype=np.int64)
    kinds[is_point] = 1
    kinds[path] = np.where(np.isin(code[path], LINES), 2, 3)
    return pa.array(["point", "line", "polygon"]).take(pa.array(kinds - 1, mask=kinds == 0)), parts


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


@dataclass(frozen=True)
class Columns:
    """The header of an attribute table: rows, bytes before the first and of each row, names and widths."""

    n: int
    head: int
    size: int
    names: tuple[str, ...]
    widths: tuple[int, ...]

    @classmethod
    def of(cls, raw: bytes) -> Columns:
        n, head, size = (int.from_bytes(raw[a:b], "little") for a, b in ((4, 8), (8, 10), (10, 12)))
        names, widths, at = [], [], 32
        while at + 32 <= min(head, len(raw)) and raw[at] != 0x0D:
            names.append(raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace"))
            widths.append(raw[at + 16])
            at += 32
        return cls(n, head, size, tuple(names), tuple(widths))


def cells(raw: bytes, columns: Columns) -> tuple[np.ndarray, list[pa.Array]]:
    """(which rows are marked as deleted, the trimmed bytes of each column) of whole rows."""
    n = len(raw) // columns.size if columns.size else 0
    block = np.frombuffer(raw[: n * columns.size], dtype=np.uint8).reshape(n, columns.size) if n else np.zeros((0, 1), dtype=np.uint8)
    out, at = [], 1
    for w in columns.widths:
        cell = block[:, at : at + w] if n else np.zeros((0, w), dtype=np.uint8)
        filled = (cell != 0x20) & (cell != 0)
        some = filled.any(axis=1) if w else np.zeros(n, dtype=bool)
        low = np.where(some, filled.argmax(axis=1) if w else 0, 0)
        high = np.where(some, cell.shape[1] - filled[:, ::-1].argmax(axis=1) if w else 0, 0)
        data = np.ascontiguousarray(cell).reshape(-1)[spread(np.arange(n) * cell.shape[1] + low, high - low)]
        out.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(high - low)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))
        at += w
    return block[:, 0] == ord("*"), out


def decoded(cell: pa.Array, encoding: str) -> pa.Array:
    """Texts of one column; encoding is utf-8, utf-8-replace or cp949. Bytes that make no character are replaced."""
    if encoding == "utf-8":
        try:
            return cell.cast(pa.string())
        except pa.ArrowInvalid:
            pass
    name = "cp949" if encoding == "cp949" else "utf-8"
    coded = cell.dictionary_encode()
    texts = pa.array([v.decode(name, "replace").strip("\0 ") for v in coded.dictionary.to_pylist()], pa.string())
    return texts.take(coded.indices)


def trouble(columns: Sequence[pa.Array]) -> tuple[bool, bool, int, int]:
    """(all cells are UTF-8, some are but show half-width katakana, cells beyond ASCII, cells that need replacements) of a range of rows."""
    valid, half, wide, bad = True, False, 0, 0
    for cell in columns:
        texts = decoded(cell, "utf-8")
        own = pc.sum(pc.match_substring(texts, "�")).as_py() or 0
        # a replacement character may stand in the file itself
        try:
            cell.cast(pa.string())
        except pa.ArrowInvalid:
            valid = False
        bad += own
        ascii_only = pc.string_is_ascii(texts)
        wide += len(texts) - (pc.sum(ascii_only).as_py() or 0)
        half |= bool(pc.any(pc.match_substring_regex(texts, _HALF_WIDTH)).as_py())
    return valid, half, wide, bad


def encoding_of(valid: bool, half: bool, wide: int, bad: int, declared: str | None, ratio_max: float) -> str:
    """UTF-8 unless it fails or shows half-width katakana. A file that declares UTF-8 and fails keeps it while few cells need replacements."""
    if valid:
        return "cp949" if half else "utf-8"
    if (declared or "").strip().upper().replace("-", "") in ("UTF8", "65001") and wide and bad / wide <= ratio_max:
        return "utf-8-replace"
    return "cp949"


def attributes(columns: Sequence[pa.Array], names: Sequence[str], n: int) -> pa.Array:
    """A map of name to text for each of n rows; rows beyond the table have none."""
    have = min(n, len(columns[0]) if columns else 0)
    k = len(columns)
    if not k or not have:
        return pa.MapArray.from_arrays(_offsets(np.zeros(n, dtype=np.int64)), pa.array([], pa.string()), pa.array([], pa.string()))
    by_row = (np.arange(have)[:, None] + have * np.arange(k)).reshape(-1)
    values = pa.concat_arrays([c.slice(0, have) for c in columns]).take(pa.array(by_row))
    keys = pa.array(list(names), pa.string()).take(pa.array(np.tile(np.arange(k), have)))
    return pa.MapArray.from_arrays(_offsets(np.where(np.arange(n) < have, k, 0)), keys, values)


def replacements(columns: Sequence[pa.Array], names: Sequence[str], n: int, more: Sequence[tuple[int, str]] = ()) -> pa.Array:
    """A list of issues for each of n rows: cells with replacement characters by column, after any others."""
    rows, texts = [np.array([i for i, _ in more], dtype=np.int64)], [[t for _, t in more]]
    for name, column in zip(names, columns, strict=True):
        at = np.flatnonzero(np.asarray(pc.match_substring(column, "�").fill_null(False)))
        at = at[at < n]
        rows.append(at)
        texts.append([f"{REPLACED} {name}"] * len(at))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    every = pa.array([t for ts in texts for t in ts], pa.string()).take(pa.array(order))
    return pa.ListArray.from_arrays(_offsets(np.bincount(row, minlength=n)), every)
