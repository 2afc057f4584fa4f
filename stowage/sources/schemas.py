"""Schemas of CSV, Parquet and Avro files as rows, and external tables over folders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import paths
from .csv_schemas import csv_columns, described_columns
from .stores import open_input, path_table, resolve

FORMATS = ("avro", "csv", "parquet")
DESCRIPTION = "file string, ordinal int, name string, type string, error string"


def hive_columns(schema: StructType) -> list[tuple[int, str, str]]:
    """(ordinal, name, Hive type) of each column; nested types are spelled out."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]


# --- CSV --------------------------------------------------------------------


def _own_file(path: Column) -> Column:
    """Spark's own markers, stream logs and checksums."""
    name = paths.file_name(path)
    return (name == "_SUCCESS") | name.rlike(r"^\..*\.crc$") | path.contains("/_spark_metadata/")


def _data_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return path_table(spark, path).where(~_own_file(F.col("path")))


def csv_schema(spark: SparkSession, path: str | list[str], sep: str = ",", all_strings: bool = False) -> StructType:
    """Header names with the types that fit the values of all files; columns without a name are called ``col<N>``.

    Lines may have more fields than the header; those fields count as columns. A file that cannot be read fails.
    """
    found = described_columns(csv_columns(_data_files(spark, path), sep), F.lit("")).orderBy("ordinal").collect()
    problem = next((r for r in found if r["error"] is not None), None)
    if problem:
        raise ValueError(f"{problem['file']}: {problem['error']}")
    kinds = (r["type"] if not all_strings else "string" for r in found)
    return StructType([StructField(r["name"], _type_named(kind)) for r, kind in zip(found, kinds)])


def _type_named(name: str) -> DataType:
    return StructType.fromDDL(f"c {name}").fields[0].dataType


#: Quotes inside quoted fields are doubled, as the description reads them.
CSV_READING = {"header": "true", "enforceSchema": "true", "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", all_strings: bool = False, multi_line: bool = False
) -> DataFrame:
    """The rows under `csv_schema`; `multi_line` for quoted line breaks, which keep Spark from splitting files."""
    schema = csv_schema(spark, path, sep, all_strings)
    return spark.read.options(sep=sep, multiLine=multi_line, **CSV_READING).schema(schema).csv(path)


# --- Parquet ----------------------------------------------------------------

# Spark's reading of the Arrow types that are named differently.
ARROW_NAMES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "halffloat": "float", "float": "float", "double": "double",
    "string": "string", "large_string": "string", "binary": "binary", "large_binary": "binary",
    "date32[day]": "date",
}


# Fixed value: the footer key under which Spark keeps the schema it wrote.
SPARK_SCHEMA_KEY = b"org.apache.spark.sql.parquet.row.metadata"


def _arrow_to_hive(kind: pa.DataType, has_int96: bool) -> str:
    def inner(part: pa.DataType) -> str:
        return _arrow_to_hive(part, has_int96)

    if pa.types.is_struct(kind):
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return f"struct<{','.join(f'{f.name}:{inner(f.type)}' for f in fields)}>"
    if pa.types.is_map(kind):
        return f"map<{inner(kind.key_type)},{inner(kind.item_type)}>"
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"array<{inner(kind.value_type)}>"
    if pa.types.is_decimal(kind):
        return f"decimal({kind.precision},{kind.scale})"
    if pa.types.is_timestamp(kind):
        # the old 96-bit form has no zone mark, but holds instants
        instant = kind.tz is not None or (has_int96 and kind.unit == "ns")
        return "timestamp" if instant else "timestamp_ntz"
    if pa.types.is_fixed_size_binary(kind):
        return "binary"
    return ARROW_NAMES.get(str(kind), "string")


def _parquet_rows(path: str) -> list[tuple[str, int, str, str]]:
    with open_input(path) as source:
        footer = pq.ParquetFile(source)
        written_by_spark = (footer.metadata.metadata or {}).get(SPARK_SCHEMA_KEY)
        leaves = [footer.schema.column(i) for i in range(len(footer.schema))]
        schema = footer.schema_arrow
    if written_by_spark:
        return [(path, *c) for c in hive_columns(StructType.fromJson(json.loads(written_by_spark)))]
    has_int96 = any(leaf.physical_type == "INT96" for leaf in leaves)
    return [(path, i, f.name, _arrow_to_hive(f.type, has_int96)) for i, f in enumerate(schema)]


# --- Avro -------------------------------------------------------------------

AVRO_MAGIC = b"Obj\x01"

# Hive names of Avro primitives and logical types.
AVRO_NAMES = {
    "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double",
    "bytes": "binary", "string": "string", "null": "void", "fixed": "binary", "enum": "string",
}
AVRO_LOGICAL_NAMES = {
    "date": "date", "timestamp-millis": "timestamp", "timestamp-micros": "timestamp",
    "local-timestamp-millis": "timestamp_ntz", "local-timestamp-micros": "timestamp_ntz",
}


def _avro_to_hive(kind, named: dict[str, str]) -> str:
    if isinstance(kind, str):
        return named.get(kind) or AVRO_NAMES.get(kind, "string")
    if isinstance(kind, list):
        branches = [k for k in kind if k != "null"]
        return _avro_to_hive(branches[0], named) if len(branches) == 1 else "string"
    logical = kind.get("logicalType")
    if logical == "decimal":
        return f"decimal({kind['precision']},{kind.get('scale', 0)})"
    if logical in AVRO_LOGICAL_NAMES:
        return AVRO_LOGICAL_NAMES[logical]
    shape = kind["type"]
    if shape == "record":
        inner = ",".join(f"{f['name']}:{_avro_to_hive(f['type'], named)}" for f in kind["fields"])
        hive = f"struct<{inner}>"
    elif shape == "array":
        hive = f"array<{_avro_to_hive(kind['items'], named)}>"
    elif shape == "map":
        hive = f"map<string,{_avro_to_hive(kind['values'], named)}>"
    else:
        hive = _avro_to_hive(shape, named)
    if "name" in kind:
        named[kind["name"]] = hive
    return hive


def _avro_long(source) -> int:
    """One zigzag-coded variable-length integer."""
    value = shift = 0
    while True:
        byte = source.read(1)[0]
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def avro_schema_json(path: str) -> str:
    """The schema text in the header of an Avro container file."""
    with open_input(path) as source:
        if source.read(4) != AVRO_MAGIC:
            raise ValueError(f"not an Avro container: {path}")
        while count := _avro_long(source):
            if count < 0:  # a negative count is followed by the block's size
                _avro_long(source)
            for _ in range(abs(count)):
                key = source.read(_avro_long(source)).decode()
                value = source.read(_avro_long(source))
                if key == "avro.schema":
                    return value.decode()
    raise ValueError(f"no schema in Avro container: {path}")


def _avro_rows(path: str) -> list[tuple[str, int, str, str]]:
    schema = json.loads(avro_schema_json(path))
    named: dict[str, str] = {}
    return [
        (path, i, f["name"], _avro_to_hive(f["type"], named))
        for i, f in enumerate(schema["fields"])
    ]


# --- description and tables -------------------------------------------------


def describe_files(
    spark: SparkSession, path: str | list[str], fmt: str, sep: str = ","
) -> DataFrame:
    """(file, ordinal, name, Hive type, error) of every column of every file.

    Parquet and Avro files are described from their headers by the executors, whatever their
    names; any file that cannot be read as one gives a row with `error`. Only Spark's own
    markers, stream logs and checksums are left out.
    CSV files are described from their values, all files in one job.
    """
    if fmt == "csv":
        return described_columns(csv_columns(_data_files(spark, path), sep))
    if fmt not in FORMATS:
        raise ValueError(f"cannot describe {fmt} files, only {', '.join(FORMATS)}")
    of_file = {"parquet": _parquet_rows, "avro": _avro_rows}[fmt]
    columns = ["file", "ordinal", "name", "type", "error"]

    def described(file: str) -> list[tuple]:
        try:
            return [(*row, None) for row in of_file(file)]
        except (OSError, EOFError, ValueError, pa.ArrowException) as problem:
            return [(file, None, None, None, str(problem))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                frame = pd.DataFrame(described(file), columns=columns)
                yield frame.astype({"ordinal": "Int32"})

    return _data_files(spark, path).select("path").mapInPandas(read, DESCRIPTION)


def format_of(path: str) -> str:
    """Format by extension; anything but avro, csv and parquet is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    ending = name.rsplit(".", 1)[-1] if "." in name else ""
    if ending not in FORMATS:
        raise ValueError(f"no external table for extension {ending!r}, only {', '.join(FORMATS)}")
    return ending


def write_avsc(path: str) -> str:
    """Write the schema of an Avro file next to its folder unless it is there already."""
    folder, name = path.rsplit("/", 1)
    target = f"{folder.rsplit('/', 1)[0]}/{name.rsplit('.', 1)[0]}.avsc"
    system, target_path = resolve(target)
    if system.get_file_info(target_path).type.name == "NotFound":
        text = json.dumps(json.loads(avro_schema_json(path)), indent=2)
        with system.open_output_stream(target_path) as out:
            out.write(text.encode())
    return target


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_external(
    spark: SparkSession,
    db: str,
    table: str,
    path: str,
    fmt: str | None = None,
    sep: str = ",",
    all_strings: bool = False,
) -> DataFrame:
    """Create an external table over the folder of a data file.

    The format follows the file's extension unless given. Creating a table that
    exists fails. Avro needs a Hive catalog or Spark's Avro module, and leaves a
    schema file one folder above the data.
    """
    kind = fmt or format_of(path)
    if kind not in FORMATS:
        raise ValueError(f"cannot register {kind} files, only {', '.join(FORMATS)}")
    is_file = path.rsplit("/", 1)[-1].endswith(f".{kind}")
    location = _quoted(path.rsplit("/", 1)[0] if is_file else path)
    name = f"`{db}`.`{table}`"
    if kind == "parquet":
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION {location}")
    elif kind == "csv":
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}"
            for f in csv_schema(spark, path, sep, all_strings).fields
        )
        options = f"header 'true', enforceSchema 'true', escape '\"', sep {_quoted(sep)}"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING csv OPTIONS ({options}) LOCATION {location}")
    else:
        if is_file:
            write_avsc(path)
        hive = spark.conf.get("spark.sql.catalogImplementation") == "hive"
        how = "STORED AS AVRO" if hive else "USING avro"
        external = "EXTERNAL " if hive else ""
        literal = (
            f" TBLPROPERTIES ('avro.schema.literal' = {_quoted(avro_schema_json(path))})"
            if hive and is_file
            else ""
        )
        columns = ""
        if hive and is_file:
            columns = " (" + ", ".join(f"`{n}` {t}" for _, _, n, t in _avro_rows(path)) + ")"
        spark.sql(f"CREATE {external}TABLE {name}{columns} {how} LOCATION {location}{literal}")
    return spark.table(f"{db}.{table}")
