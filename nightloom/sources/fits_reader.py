"""FITS files as a Spark data source: only the bytes that a query needs are read.

    spark.dataSource.register(FitsSource)
    spark.read.format("fits").schema("path string, FILTER string, EXPTIME double, data array<float>").load(folder)

Columns path, cards, bitpix, width, height, channels and data are the file's own; every other column is the header key of its
name. Headers are read in blocks up to their end; pixels are read, by their range, only where the schema has `data` and only for
files whose header meets the filters that Spark hands down (spark.sql.python.filterPushdown.enabled). Folders may be in any store that
pyarrow's file systems open; files are named .fit or .fits in any case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StructType

from .fits import DTYPES, UNIT, parse

OWN = ("path", "cards", "bitpix", "width", "height", "channels", "data")
DEFAULT = "path string, header map<string,string>, bitpix int, width int, height int, channels int, data array<float>"
#: Filters that the header alone decides.
TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value, In: lambda v, f: v is not None and v in f.value, IsNull: lambda v, f: v is None, IsNotNull: lambda v, f: v is not None,
    GreaterThan: lambda v, f: v is not None and v > f.value, GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value, LessThan: lambda v, f: v is not None and v < f.value, LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def header_of(file) -> tuple[list[tuple], int]:
    """Cards of an open file, read block by block, and where the data begin."""
    raw = b""
    while True:
        block = file.read(UNIT)
        if not block:
            raise ValueError("the header has no end")
        raw += block
        if any(block[k : k + 8].rstrip() == b"END" for k in range(0, len(block), 80)):
            return parse(raw)


def _typed(value: str | None, kind) -> object:
    if value is None or value == "undefined":
        return None
    try:
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value.replace("D", "E"))
        if isinstance(kind, (LongType, IntegerType)):
            return int(float(value))
    except ValueError:
        return None
    return value == "T" if isinstance(kind, BooleanType) else value


class FitsReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, per_task: int):
        self.path, self.schema, self.per_task, self.filters = path, schema, per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters on columns that the header gives; the others stay with Spark."""
        names = {f.name for f in self.schema.fields} - {"cards", "data", "header"}
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in names:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, root = _file_system(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".fit", ".fits")))
        return [Files(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        store, _ = _file_system(self.path)
        for path in partition.value:
            with store.open_input_file(path) as file:
                cards, at = header_of(file)
                value: dict[str, str] = {}
                for c in cards:
                    if c[0] not in ("COMMENT", "HISTORY"):
                        value.setdefault(c[0], c[1])
                axes = [int(value[f"NAXIS{i + 1}"]) for i in range(int(value.get("NAXIS", "0")))]
                size = [*axes, 1, 1, 1][:3]
                row = {"path": path, "header": value, "cards": None, "bitpix": int(value.get("BITPIX", 0)), "width": size[0], "height": size[1], "channels": size[2], "data": None}
                for f in self.schema.fields:
                    if f.name not in row:
                        row[f.name] = _typed(value.get(f.name), f.dataType)
                    elif f.name == "cards":
                        row["cards"] = [tuple(c) for c in cards]
                if not all(TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters):
                    continue
                if axes and any(f.name == "data" for f in self.schema.fields):
                    kind = DTYPES[row["bitpix"]]
                    file.seek(at)
                    n = int(np.prod(axes))
                    raw = np.frombuffer(file.read(n * np.dtype(kind).itemsize), dtype=kind, count=n)
                    row["data"] = (raw.astype(np.float64) * float(value.get("BSCALE", 1)) + float(value.get("BZERO", 0))).astype(np.float32).tolist()
            yield tuple(row[f.name] for f in self.schema.fields)


class FitsSource(DataSource):
    """Options: path; files: how many a task reads (default 64)."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return DEFAULT

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(self.options["path"], schema, int(self.options.get("files", 64)))
