"""Layers written as files of a delivery: each task writes its rows as sections of up to FILE_ROWS rows or FILE_BYTES.

The counterpart of the readers, for deliveries made from tables. A file is written under a name of its own and renamed
when it is whole, so that a task that runs twice leaves one file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import opened
from .records import HEADER, LINES, POINTS, POLYGONS, spread

_CODES = {"point": POINTS[0], "line": LINES[0], "polygon": POLYGONS[0]}
#: Coordinates in metres of a plane of their own.
PLANE = b'LOCAL_CS["plane",UNIT["metre",1]]'
#: Widest cell of an attribute table.
WIDEST = 254
#: Rows of a file, at most but for the last batch, and bytes of its rows in Arrow. A task holds one file's rows; the format ends at 2 GB.
FILE_ROWS, FILE_BYTES = 100_000, 64 << 20


def _put(buf: np.ndarray, at: np.ndarray, values: np.ndarray, kind: str) -> None:
    width = np.dtype(kind).itemsize
    if len(at):
        buf[at[:, None] + np.arange(width)] = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, width)


def encoded_shapes(kind: str, parts: pa.Array) -> tuple[bytes, bytes]:
    """(main file, index file) of shapes in the plane; a shape without parts is written as a missing one."""
    n_parts = np.asarray(pc.fill_null(pc.list_value_length(parts), 0), dtype=np.int64)
    inner = parts.flatten()
    size = np.asarray(pc.fill_null(pc.list_value_length(inner), 0), dtype=np.int64)
    points = inner.flatten()
    xy = np.stack([np.asarray(points.field(c), dtype=np.float64) for c in "xy"], axis=1)
    owner = np.repeat(np.arange(len(n_parts)), n_parts)
    n_points = np.bincount(owner, weights=size, minlength=len(n_parts)).astype(np.int64)
    filled = n_points > 0
    is_point = kind == "point"
    content = np.where(filled, 20 if is_point else 44 + 4 * n_parts + 16 * n_points, 4)
    offset = HEADER + np.cumsum(content + 8) - content - 8
    out = np.zeros(int(HEADER + (content + 8).sum()), dtype=np.uint8)
    index = np.zeros(HEADER + 8 * len(n_parts), dtype=np.uint8)
    for buf in (out, index):
        _put(buf, np.array([0]), np.array([9994]), ">i4")
        _put(buf, np.array([24]), np.array([len(buf) // 2]), ">i4")
        _put(buf, np.array([28]), np.array([1000]), "<i4")
        _put(buf, np.array([32]), np.array([_CODES[kind]]), "<i4")
    _put(index, HEADER + 8 * np.arange(len(n_parts)), offset // 2, ">i4")
    _put(index, HEADER + 8 * np.arange(len(n_parts)) + 4, content // 2, ">i4")
    _put(out, offset, np.arange(1, len(n_parts) + 1), ">i4")
    _put(out, offset + 4, content // 2, ">i4")
    body = offset + 8
    _put(out, body, np.where(filled, _CODES[kind], 0), "<i4")
    some = np.flatnonzero(filled)
    if is_point:
        first = np.cumsum(n_points) - n_points
        _put(out, body[some] + 4, xy[first[some], 0], "<f8")
        _put(out, body[some] + 12, xy[first[some], 1], "<f8")
        return out.tobytes(), index.tobytes()
    begin = (np.cumsum(n_points) - n_points)[some]
    for i, (pick, axis) in enumerate(((np.minimum, 0), (np.minimum, 1), (np.maximum, 0), (np.maximum, 1))):
        _put(out, body[some] + 4 + 8 * i, pick.reduceat(xy[:, axis], begin) if len(some) else begin, "<f8")
    _put(out, body[some] + 36, n_parts[some], "<i4")
    _put(out, body[some] + 40, n_points[some], "<i4")
    starts = np.cumsum(size) - size - np.repeat(np.cumsum(n_points) - n_points, n_parts)
    _put(out, spread((body + 44)[some], n_parts[some], 4), starts[filled[owner]], "<i4")
    _put(out, spread((body + 44 + 4 * n_parts)[some], 2 * n_points[some], 8), xy.reshape(-1), "<f8")
    return out.tobytes(), index.tobytes()


def encoded_table(columns: dict[str, pa.Array]) -> bytes:
    """An attribute table of texts in UTF-8, each column as wide as its longest cell; longer cells than WIDEST are an error."""
    cells = {}
    for name, column in columns.items():
        raw = np.array([(v or "").encode() for v in column.to_pylist()], dtype=bytes)
        width = max(1, raw.dtype.itemsize)
        if width > WIDEST:
            raise ValueError(f"{name}: a cell of {width} bytes")
        block = raw.astype(f"S{width}").view(np.uint8).reshape(len(raw), width)
        cells[name] = np.where(block == 0, 0x20, block).astype(np.uint8)
    n = len(next(iter(cells.values())))
    size = 1 + sum(c.shape[1] for c in cells.values())
    head = bytes([3, 0, 0, 0]) + n.to_bytes(4, "little") + (32 + 32 * len(cells) + 1).to_bytes(2, "little") + size.to_bytes(2, "little") + b"\0" * 20
    fields = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([c.shape[1], 0]) + b"\0" * 14 for name, c in cells.items())
    return head + fields + b"\r" + np.concatenate([np.full((n, 1), 0x20, dtype=np.uint8), *cells.values()], axis=1).tobytes()


def write_layer(rows: DataFrame, layer: str, kind: str, root: str, coordinate: str) -> int:
    """Write rows (parts, and texts in all other columns) as root/SEC<task>-<file>/coordinate/layer.*; the number of rows written."""
    names = [c for c in rows.columns if c != "parts"]
    most_rows, most_bytes = FILE_ROWS, FILE_BYTES

    def put(got: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(got).combine_chunks()
        folder = f"{root}/SEC{TaskContext.get().partitionId():05d}-{number:04d}/{coordinate}"
        shp, shx = encoded_shapes(kind, table.column("parts").combine_chunks())
        dbf = encoded_table({c: table.column(c) for c in names})
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        for suffix, content in (("shx", shx), ("dbf", dbf), ("cpg", b"UTF-8"), ("prj", PLANE), ("shp", shp)):
            own = f"{path}/.{layer}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(content)
            store.move(own, f"{path}/{layer}.{suffix}")
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64())], names=["n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, number = [], 0
        for b in batches:
            if b.num_rows:
                got.append(b)
            if sum(g.num_rows for g in got) >= most_rows or sum(g.nbytes for g in got) >= most_bytes:
                yield put(got, number)
                got, number = [], number + 1
        if got:
            yield put(got, number)

    texts = rows.select("parts", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))
    return texts.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
