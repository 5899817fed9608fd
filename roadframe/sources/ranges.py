"""A Spark data source that reads layer files in ranges of records.

The size of an index file tells how many records its shapefile has, so a file is cut into ranges before any
of it is read. A task reads the index entries of its range, the stretch of the main file they cover and
the rows of the attribute table, and yields Arrow batches. In mode "probe" it looks at the attribute table alone and tells what a
file's encoding is decided by.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import records as R

RAW = "layer string, section string, source_path string, source_row long, ord long, attributes map<string,string>, geom_kind string, parts array<array<struct<x:double,y:double,z:double>>>, issues array<string>"
PROBE = "path string, valid boolean, half boolean, wide long, bad long, declared string"
ARROW = pa.schema([("layer", pa.string()), ("section", pa.string()), ("source_path", pa.string()), ("source_row", pa.int64()), ("ord", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string())), ("geom_kind", pa.string()), ("parts", R.PARTS), ("issues", pa.list_(pa.string()))])
_PROBED = pa.schema([("path", pa.string()), ("valid", pa.bool_()), ("half", pa.bool_()), ("wide", pa.int64()), ("bad", pa.int64()), ("declared", pa.string())])
#: Bytes of the main file that a task should read, and records of a batch.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 8192
#: Rows of different files never share an ord: file_rank times this, plus the row.
FILE_ORDS = 1 << 40


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    plain = re.sub(r"^file:/+", "/", path)
    if "://" not in plain:
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", plain))


def in_reach(path: str) -> bool:
    """Whether Python can read ranges of a path. Stores that only Spark reads are read whole, file by file."""
    try:
        store, name = opened(path)
        return store.get_file_info(name).type == fs.FileType.File
    except (pa.ArrowException, OSError, NotImplementedError):
        return False


def _bytes(path: str, start: int = 0, n: int | None = None) -> bytes:
    store, name = opened(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(n)


def _size(path: str | None) -> int:
    if path is None:
        return 0
    store, name = opened(path)
    return store.get_file_info(name).size or 0


@dataclass(frozen=True)
class LayerFile:
    """One layer file: its main file and, where they are there, index, attribute table and declared encoding."""

    path: str
    layer: str
    section: str | None
    file_rank: int
    shx: str | None = None
    dbf: str | None = None
    cpg: str | None = None
    encoding: str = "utf-8"


@dataclass
class Range(InputPartition):
    """Records first to last - 1 of a file; last None means all that follow."""

    file: LayerFile
    first: int
    last: int | None


def batches(file: LayerFile, row: int, raw: bytes, base: int, offsets: np.ndarray, lengths: np.ndarray, columns: R.Columns | None, rows: bytes, n_table: int | None, n_shapes: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of a range whose first record is `row`: raw holds the main file from byte `base` on, rows the table from that record on.

    A row that its table marks as deleted is left out together with its shape; the others keep their places.
    """
    for a in range(0, len(offsets), BATCH_ROWS):
        b = min(a + BATCH_ROWS, len(offsets))
        n = b - a
        kinds, parts = R.shapes(raw, offsets[a:b] - base, lengths[a:b])
        deleted, cells, names = np.zeros(0, dtype=bool), [], ()
        if columns is not None:
            deleted, cells = R.cells(rows[a * columns.size : b * columns.size], columns)
            cells, names = [R.decoded(c, file.encoding) for c in cells], columns.names
        odd = [(0, R.MISMATCH)] if row + a == 0 and names and n_table is not None and n_table != n_shapes else []
        issues = R.replacements(cells, names, n, odd) if file.encoding == "utf-8-replace" else R.replacements((), (), n, odd)
        at = np.arange(row + a, row + b)
        out = pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(file.layer), n), pa.repeat(pa.scalar(file.section, pa.string()), n), pa.repeat(pa.scalar(file.path), n), pa.array(at), pa.array(at + file.file_rank * FILE_ORDS), R.attributes(cells, names, n), kinds, parts, issues], schema=ARROW
        )
        gone = np.zeros(n, dtype=bool)
        gone[: len(deleted)] = deleted[:n]
        yield out.filter(pa.array(~gone)) if gone.any() else out


def whole(file: LayerFile, shp: bytes, dbf: bytes | None, cpg: bytes | None, ratio_max: float) -> Iterator[pa.RecordBatch]:
    """All rows of a file that is at hand whole."""
    offsets, lengths = R.walked(shp)
    columns = R.Columns.of(dbf) if dbf else None
    rows = dbf[columns.head :] if columns is not None else b""
    if columns is not None:
        found = R.trouble(R.cells(rows[: columns.n * columns.size], columns)[1])
        declared = cpg.decode("ascii", "replace") if cpg is not None else None
        file = LayerFile(file.path, file.layer, file.section, file.file_rank, encoding=R.encoding_of(*found, declared, ratio_max))
        rows = rows[: columns.n * columns.size]
    yield from batches(file, 0, shp, 0, offsets, lengths, columns, rows, columns.n if columns else None, len(offsets))


class LayerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [LayerFile(**f) for f in json.loads(options["files"])]
        self.probe = options.get("mode") == "probe"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for file in self.files:
            size = _size(file.dbf) if self.probe else _size(file.path)
            if self.probe:
                if file.dbf is None:
                    continue
                n = R.Columns.of(_bytes(file.dbf, 0, 32)).n
            else:
                n = max(0, _size(file.shx) - R.HEADER) // R.ENTRY if file.shx is not None else None
            if n is None:
                out.append(Range(file, 0, None))
                continue
            step = max(1, n * self.range_bytes // max(size, 1))
            out += [Range(file, a, min(a + step, n)) for a in range(0, n, step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        # Spark asks for one partition where there is none
        if part is not None:
            yield from self._probed(part) if self.probe else self._rows(part)

    def _table(self, part: Range, n: int) -> tuple[R.Columns | None, bytes]:
        """The header of the attribute table and its rows for n records of a range."""
        if part.file.dbf is None:
            return None, b""
        head = int.from_bytes(_bytes(part.file.dbf, 8, 2), "little")
        columns = R.Columns.of(_bytes(part.file.dbf, 0, head))
        n = max(0, min(n, columns.n - part.first))
        return columns, _bytes(part.file.dbf, columns.head + part.first * columns.size, n * columns.size)

    def _probed(self, part: Range) -> Iterator[pa.RecordBatch]:
        columns, rows = self._table(part, part.last - part.first)
        declared = _bytes(part.file.cpg).decode("ascii", "replace") if part.file.cpg is not None else None
        step = BATCH_ROWS * max(1, columns.size)
        seen = [R.trouble(R.cells(rows[a : a + step], columns)[1]) for a in range(0, len(rows), step)]
        valid, half, wide, bad = all(x[0] for x in seen), any(x[1] for x in seen), sum(x[2] for x in seen), sum(x[3] for x in seen)
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((part.file.path, valid, half, wide, bad, declared), _PROBED, strict=True)], schema=_PROBED)

    def _rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        file = part.file
        if part.last is None:
            raw, base = _bytes(file.path), 0
            offsets, lengths = R.walked(raw)
            n_shapes = len(offsets)
        else:
            offsets, lengths = R.index_entries(_bytes(file.shx, R.HEADER + R.ENTRY * part.first, R.ENTRY * (part.last - part.first)))
            n_shapes = max(0, _size(file.shx) - R.HEADER) // R.ENTRY
            size = _size(file.path)
            inside = (offsets >= R.HEADER) & (offsets + 8 + lengths <= size)
            base = int(offsets[inside].min()) if inside.any() else 0
            raw = _bytes(file.path, base, int((offsets + 8 + lengths)[inside].max()) - base) if inside.any() else b""
        columns, rows = self._table(part, len(offsets))
        yield from batches(file, part.first, raw, base, offsets, lengths, columns, rows, columns.n if columns else None, n_shapes)


class LayerFiles(DataSource):
    """Options: files (JSON of LayerFile records), mode ("rows" or "probe"), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "layer_files"

    def schema(self) -> str:
        return PROBE if self.options.get("mode") == "probe" else RAW

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options)
