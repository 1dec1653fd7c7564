"""The columns of a Parquet file, from its footer."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from millrace.errors import SourceProblem
from millrace.sources.parquet import is_pattern


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    physical_type: str
    logical_type: str
    required: bool
    optional: bool
    repeated: bool


# Friendly names by logical, then by physical type.
_BY_LOGICAL = {"STRING": "STRING", "ENUM": "ENUM", "UUID": "UUID", "DATE": "DATE", "TIME": "TIME", "TIMESTAMP": "TIMESTAMP", "DECIMAL": "DECIMAL", "JSON": "JSON", "BSON": "BSON"}
_BY_PHYSICAL = {
    "BOOLEAN": "BOOLEAN", "INT32": "INT32", "INT64": "INT64", "INT96": "INT96", "FLOAT": "FLOAT32", "DOUBLE": "FLOAT64", "BYTE_ARRAY": "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY": "FIXED_LEN_BYTE_ARRAY",
}


def _logical(column) -> str:
    text = str(column.logical_type)
    return "" if text in ("None", "Unknown") else text.upper() if "(" not in text else text


def _friendly(logical: str, physical: str) -> str:
    name = logical.split("(")[0].upper()
    return _BY_LOGICAL.get(name) or _BY_PHYSICAL.get(physical, "UNKNOWN")


def _repetition(schema, path: str) -> tuple[bool, bool]:
    """Whether a leaf, or anything around it, is repeated or optional; list and map wrappers don't show in names."""
    for i in range(len(schema)):
        if schema.column(i).path == path:
            column = schema.column(i)
            repeated = column.max_repetition_level > 0
            return repeated, not repeated and column.max_definition_level > 0
    return False, False


def _dotted(path: str) -> str:
    """The name without the groups that only wrap lists."""
    parts = path.split(".")
    out = [p for i, p in enumerate(parts) if not (p in ("list", "bag") and i + 1 < len(parts) and parts[i + 1] in ("element", "item", "array_element", "array"))]
    if len(out) < len(parts) and out[-1] in ("element", "item", "array_element", "array"):
        out.pop()
    return ".".join(out)


def column_infos(path: str) -> list[ColumnInfo]:
    """One record per leaf column of a file; of a pattern or folder, of its first file."""
    try:
        where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        if is_pattern(inner) or where.get_file_info(inner).type == fs.FileType.Directory:
            inner = _first(where, inner)
        with where.open_input_file(inner) as file:
            schema = pq.ParquetFile(file).schema
    except SourceProblem:
        raise
    except Exception as e:
        raise SourceProblem(f"cannot read the schema of {path}: {e}") from e
    out = []
    for i in range(len(schema)):
        column = schema.column(i)
        repeated, optional = _repetition(schema, column.path)
        logical = _logical(column)
        out.append(ColumnInfo(_dotted(column.path), _friendly(logical, column.physical_type), column.physical_type, logical, not repeated and not optional, optional, repeated))
    return out


def _first(where: fs.FileSystem, path: str) -> str:
    import fnmatch

    base = path if not is_pattern(path) else path[: min(path.find(c) for c in "*?[{" if c in path)].rpartition("/")[0] or "."
    found = sorted(f.path for f in where.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File)
    wanted = [f for f in found if (fnmatch.fnmatch(f, path) if is_pattern(path) else f.endswith(".parquet"))]
    if not wanted:
        raise SourceProblem(f"no files match pattern: {path}")
    return wanted[0]


def schema_table(spark: SparkSession, path: str) -> DataFrame:
    """The same records as a DataFrame."""
    kind = "name string, type string, physical_type string, logical_type string, required boolean, optional boolean, repeated boolean"
    return spark.createDataFrame([asdict(c) for c in column_infos(path)], kind)
