"""A data source over the trees in which rows are kept, tolerant of damaged parts.

    raw/date=2024-01-01/hour=05/symbol=X/kind=trades/part.parquet    (any key=value levels)
    preview/...                                                      (likewise)
    ready/<kind>/<symbol>/part.jsonl                                 (or .parquet)

The driver lists files only; each file is read in parts of about PART bytes, a part taking
every so-many-th row group, so large files are shared and no footer is read to plan. What
a path says (kind, symbol, date) prunes files, and times prune row groups by their
statistics. A row group that can't be read costs only itself, a line that is no JSON only
that line, and a file without a readable footer that file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PART = 128 << 20
LAYOUTS = ("ready", "preview", "raw")


@dataclass
class FilePart(InputPartition):
    path: str
    known: dict[str, str]
    number: int = 0
    of: int = 1
    value: object = field(default=None, repr=False)


def known_by_path(path: str, layout: str) -> dict[str, str]:
    """What a file's folders (relative to the layout's) say: key=value levels, or kind and symbol under ready/."""
    folders = path.split("/")[:-1]
    out = dict(f.split("=", 1) for f in folders if "=" in f)
    if layout == "ready" and not out and len(folders) >= 2:
        out = {"kind": folders[-2], "symbol": folders[-1]}
    return out


class LayoutReader(DataSourceReader):
    def __init__(self, schema: StructType, root: str, layouts: list[str], part: int):
        self.schema, self.root, self.layouts, self.part = schema, root, layouts, part
        self.equal: dict[str, set[str]] = {}
        self.low = self.high = None

    def pushFilters(self, filters):
        """Takes equalities on what paths say, and bounds of ts_ms; Spark checks all of them again but the first kind."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in ("kind", "symbol", "date") and isinstance(f, (EqualTo, In)):
                values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.equal[column] = self.equal.get(column, values) & values
            if column == "ts_ms" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = f.value if self.low is None else max(self.low, f.value)
            if column == "ts_ms" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self):
        out = []
        for layout in self.layouts:
            fs, base = pafs.FileSystem.from_uri(f"{self.root}/{layout}") if "://" in self.root else (pafs.LocalFileSystem(), f"{self.root}/{layout}")
            for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
                name = info.path.rsplit("/", 1)[-1]
                if info.type != pafs.FileType.File or name[0] in "._" or not name.endswith((".parquet", ".jsonl")):
                    continue
                known = known_by_path(info.path[len(base) :], layout)
                if any(c in known and known[c] not in v for c, v in self.equal.items()):
                    continue
                known["layout"] = layout
                parts = max(1, -(-info.size // self.part)) if name.endswith(".parquet") else 1
                out += [FilePart(info.path, known, i, parts) for i in range(parts)]
        return out or [FilePart("", {})]

    def _batch(self, columns: dict[str, pa.Array], n: int, known: dict[str, str]) -> pa.RecordBatch:
        """The schema's columns: the row's own value, else what the path says, else null."""
        types = _arrow(self.schema)
        arrays = []
        for f in types:
            x = columns.get(f.name)
            if x is None:
                x = pa.nulls(n, f.type)
            x = x.cast(f.type)
            if f.name in known and x.null_count:
                x = x.fill_null(pa.scalar(known[f.name]).cast(f.type))
            arrays.append(x)
        return pa.RecordBatch.from_arrays(arrays, schema=types)

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root else pafs.LocalFileSystem()
        with fs.open_input_file(partition.path) as f:
            if partition.path.endswith(".jsonl"):
                yield from self._lines(f, partition.known)
            else:
                yield from self._groups(f, partition)

    def _groups(self, f, partition: FilePart) -> Iterator[pa.RecordBatch]:
        try:
            file = pq.ParquetFile(f)
        except (pa.ArrowException, OSError):
            return  # no readable footer
        wanted = [c for c in self.schema.names if c in file.schema_arrow.names]
        at = file.schema_arrow.names.index("ts_ms") if "ts_ms" in file.schema_arrow.names else None
        for i in range(partition.number, file.num_row_groups, partition.of):
            meta = file.metadata.row_group(i)
            stats = meta.column(at).statistics if at is not None else None
            if stats is not None and stats.has_min_max and ((self.low is not None and stats.max < self.low) or (self.high is not None and stats.min > self.high)):
                continue
            try:
                table = file.read_row_group(i, columns=wanted)
            except (pa.ArrowException, OSError):
                continue  # this row group is damaged
            n = meta.num_rows
            yield self._batch({c: table.column(c).combine_chunks() for c in wanted}, n, partition.known)

    def _lines(self, f, known: dict[str, str]) -> Iterator[pa.RecordBatch]:
        types, rows = _arrow(self.schema), []

        def made():
            n = len(rows)
            return self._batch({t.name: pa.array([_as(r.get(t.name), t.type) for r in rows], t.type) for t in types if any(t.name in r for r in rows)}, n, known)

        for line in _text_lines(f):
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                rows.append(row)
            if len(rows) == 10_000:
                yield made()
                rows = []
        if rows:
            yield made()


def _text_lines(f) -> Iterator[bytes]:
    rest = b""
    while block := f.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest.strip():
        yield rest


def _as(v, kind: pa.DataType):
    """A JSON value in the column's type, null if it is of another."""
    try:
        return pa.scalar(v, kind).as_py() if v is not None else None
    except (pa.ArrowException, TypeError, ValueError):
        return None


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class LayoutSource(DataSource):
    """Options: path (the root), layouts (comma-separated, all if not given), part (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "ticklattice_layouts"

    def schema(self):
        return "symbol string, ts_ms long, kind string, layout string"

    def reader(self, schema: StructType) -> LayoutReader:
        own = [x.strip() for x in self.options.get("layouts", ",".join(LAYOUTS)).split(",")]
        return LayoutReader(schema, self.options["path"].rstrip("/"), own, int(self.options.get("part", PART)))


def read_layout(spark: SparkSession, root: str, schema: str, layouts: str | None = None) -> DataFrame:
    """Rows of the trees under root with the columns of schema, which may name kind, symbol, date and layout (from the paths
    where the rows have none). layouts: auto takes preview if it is there, else ready, else raw; else a list of names. Filters
    on those columns and on ts_ms reach the reader (this turns on their pushing in the session)."""
    from . import files

    if layouts == "auto":
        layouts = next((x for x in ("preview", "ready") if files.exists(spark, f"{root}/{x}")), "raw")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayoutSource)
    r = spark.read.format("ticklattice_layouts").schema(schema).option("path", root)
    return (r.option("layouts", layouts) if layouts else r).load()
