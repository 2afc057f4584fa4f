import csv
import datetime as dt
import decimal
import gzip
import io
import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from stowage.sources import csv_schemas as C, schemas as S


def described(df):
    return [(r.ordinal, r.name, r.type) for r in df.orderBy("file", "ordinal").collect()]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write(text)
    return path


def test_csv_names_and_types(spark, folder):
    path = write(f"{folder}/d/state_codes.csv", "idstate,labelstate,fullstatename\n1,AL,Alabama\n2,AK,Alaska\n")
    assert described(S.describe_files(spark, path, "csv")) == [
        (0, "idstate", "int"), (1, "labelstate", "string"), (2, "fullstatename", "string"),
    ]
    assert [f.dataType for f in S.csv_schema(spark, path, all_strings=True)] == [T.StringType()] * 3


def test_csv_surplus_columns(spark, folder):
    path = write(f"{folder}/d/wide.csv", 'a,,c\n1,x,"p,q",7,2024-01-01\n2,y,z,8\n')
    assert described(S.describe_files(spark, path, "csv")) == [
        (0, "a", "int"), (1, "col2", "string"), (2, "c", "string"), (3, "col4", "int"), (4, "col5", "date"),
    ]
    rows = [tuple(r) for r in S.read_csv(spark, path).orderBy("a").collect()]
    assert rows == [(1, "x", "p,q", 7, dt.date(2024, 1, 1)), (2, "y", "z", 8, None)]


def plain_columns(data, sep=","):
    """Header and values per column by reading the whole text at once."""
    records = [r for r in csv.reader(io.StringIO(data, newline=""), delimiter=sep) if r]
    width = max(map(len, records))
    return records[0], [[r[i] for r in records[1:] if i < len(r) and r[i]] for i in range(width)]


ODD = (
    'id,"text, with ""signs""",at,"two\nlines",n\r\n'
    + "".join(
        f'{i},"line {i}\nand ""more"" of it,\r\n\n{"x" * (i % 23)}",2024-01-{i % 28 + 1:02},5" disc {i},{i * 10**9}\n'
        for i in range(60)
    )
    + '61,plain,2024-02-01T10:00:00,"",,surplus,"7"\n\n62,"end'
)


@pytest.mark.parametrize("block", [7, 16, 40, 101, 1 << 20])
def test_csv_records_across_blocks(spark, folder, block):
    """Quotes with line breaks in them, wherever the blocks cut, give what reading the whole text gives."""
    for name, text in {"odd": ODD, "mark": "\ufeffa,b\n1,2\n", "short": "only,a\n", "cr": "a\r1\r2\r"}.items():
        with open(f"{folder}/{name}.csv", "w", newline="") as out:
            out.write(text)
    open(f"{folder}/empty.csv", "w").close()
    with gzip.open(f"{folder}/packed.csv.gz", "wt", newline="") as out:
        out.write(ODD)
    files = spark.createDataFrame(
        [(f"{folder}/{f}", os.path.getsize(f"{folder}/{f}")) for f in os.listdir(folder)] + [(f"{folder}/missing.csv", 9)],
        "path string, length long")
    found = {os.path.basename(r["file"]): r for r in C.csv_columns(files, block=block).collect()}
    assert found.pop("missing.csv")["error"] and "empty.csv" not in found
    header, values = plain_columns(ODD)
    for name in ("odd.csv", "packed.csv.gz"):
        row = found.pop(name)
        assert (row["header"], row["error"]) == (header, None)
        assert row["fits"] == [C.fitting(v) if v else C.ALL for v in values]
        assert row["seen"] == [bool(v) for v in values]
    assert {k: (r["header"], r["fits"], r["seen"]) for k, r in found.items()} == {
        "mark.csv": (["a", "b"], [7, 7], [True, True]), "short.csv": (["only", "a"], [], []), "cr.csv": (["a"], [7], [True]),
    }


def test_csv_files_of_one_job(spark, folder):
    write(f"{folder}/t/a.csv", "x,x,\n1,true,3000000000\n")
    write(f"{folder}/t/b.csv", "x,x,\n1.5,,4\n")
    os.mkdir(f"{folder}/t/sub")
    write(f"{folder}/t/sub/c.csv", "y\n2024-13-01\n")
    rows = [(os.path.basename(r["file"]), *r[1:4]) for r in S.describe_files(spark, f"{folder}/t", "csv").collect()]
    assert sorted(rows) == [
        ("a.csv", 0, "x0", "int"), ("a.csv", 1, "x1", "boolean"), ("a.csv", 2, "col3", "bigint"),
        ("b.csv", 0, "x0", "double"), ("b.csv", 1, "x1", "string"), ("b.csv", 2, "col3", "int"), ("c.csv", 0, "y", "string"),
    ]
    both = S.csv_schema(spark, [f"{folder}/t/a.csv", f"{folder}/t/b.csv"])
    assert both.simpleString() == "struct<x0:double,x1:boolean,col3:bigint>"


def test_csv_open_quote(spark, folder, monkeypatch):
    monkeypatch.setattr(C, "MAX_RECORD", 50)
    row = C.OfFile("nowhere", ",")
    row.take({"error": None, "inside": False, "start": 0, "size": 100, "first_end": 0, "last_begin": 10, "after": True,
              "header": ["a"], "fits": [], "seen": []})
    assert "left open" in row.row()[-1]


@pytest.mark.parametrize("values,type_", [
    (["1", "-2", "+3"], "int"), (["2147483648"], "bigint"), (["9" * 19], "double"), (["1", "2.5", ".5e3", "NaN"], "double"),
    (["TRUE", "false"], "boolean"), (["2024-02-29"], "date"), (["2023-02-29"], None), (["2024-01-01", "2024-01-01 10:00:00Z"], "timestamp"),
    (["1", "true"], None), ([" 1"], None), (["1,5"], None),
])
def test_narrowest_type(values, type_):
    bits = C.fitting(values)
    assert next((t for i, t in enumerate(C.TYPES) if bits >> i & 1), None) == type_


def test_csv_separator(spark, folder):
    path = write(f"{folder}/d/pipe.csv", "a|b\n1|2.5\n")
    assert described(S.describe_files(spark, path, "csv", "|")) == [(0, "a", "int"), (1, "b", "double")]


PERSON = T.StructType(
    [
        T.StructField("name", T.StringType()), T.StructField("grade", T.ByteType()),
        T.StructField("number", T.LongType()), T.StructField("weight", T.FloatType()),
        T.StructField("ratio", T.DoubleType()), T.StructField("share", T.DecimalType(38, 10)),
        T.StructField("prefix", T.ShortType()), T.StructField("extension", T.IntegerType()),
        T.StructField("born", T.DateType()), T.StructField("seen", T.TimestampType()),
        T.StructField("raw", T.BinaryType()), T.StructField("ok", T.BooleanType()),
        T.StructField("marks", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("draws", T.ArrayType(T.IntegerType())),
        T.StructField(
            "digits",
            T.StructType(
                [
                    T.StructField("phones", T.ArrayType(T.StructType([T.StructField("prefix", T.ShortType())]))),
                    T.StructField("others", T.ArrayType(T.LongType())),
                ]
            ),
        ),
    ]
)


def test_parquet_types_are_sparks_own(spark, folder):
    row = ("n", 1, 2, 1.5, 2.5, decimal.Decimal("1.5"), 3, 4, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1),
           b"x", True, {"a": 1}, [1, 2], ([(5,)], [6]))
    spark.createDataFrame([row], PERSON).coalesce(1).write.parquet(f"{folder}/p")
    want = S.hive_columns(PERSON)
    assert S.hive_columns(spark.read.parquet(f"{folder}/p").schema) == want
    files = [f for f in os.listdir(f"{folder}/p") if f.endswith(".parquet")]
    assert described(S.describe_files(spark, f"{folder}/p/{files[0]}", "parquet")) == want
    nested = dict((n, t) for _, n, t in want)
    assert nested["digits"] == "struct<phones:array<struct<prefix:smallint>>,others:array<bigint>>"


def zigzag(n):
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


AVRO = {
    "type": "record", "name": "Person", "fields": [
        {"name": "name", "type": ["null", "string"]}, {"name": "id", "type": "int"},
        {"name": "number", "type": "long"}, {"name": "weight", "type": "float"},
        {"name": "day", "type": {"type": "int", "logicalType": "date"}},
        {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        {"name": "price", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}},
        {"name": "traits", "type": {"type": "map", "values": "double"}},
        {"name": "home", "type": {"type": "record", "name": "Phone", "fields": [
            {"name": "area", "type": "int"}, {"name": "kind", "type": {"type": "enum", "name": "K", "symbols": ["A"]}}]}},
        {"name": "phones", "type": {"type": "array", "items": "Phone"}},
    ],
}
AVRO_HIVE = [
    "string", "int", "bigint", "float", "date", "timestamp", "decimal(9,2)", "map<string,double>",
    "struct<area:int,kind:string>", "array<struct<area:int,kind:string>>",
]


def write_avro(path):
    meta = {"avro.codec": b"null", "avro.schema": json.dumps(AVRO).encode()}
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(b"Obj\x01")
        # a block with a negative count carries its size as well
        body = b"".join(zigzag(len(k)) + k.encode() + zigzag(len(v)) + v for k, v in meta.items())
        out.write(zigzag(-len(meta)) + zigzag(len(body)) + body + zigzag(0) + b"s" * 16)
    return path


def test_avro_header(spark, folder):
    write_avro(f"{folder}/top/data/p.avro")
    write_avro(f"{folder}/top/data/q.avro")
    rows = S.describe_files(spark, f"{folder}/top/data", "avro").collect()
    assert len(rows) == 2 * len(AVRO_HIVE)
    names = [f["name"] for f in AVRO["fields"]]
    want = [(i, n, t) for i, (n, t) in enumerate(zip(names, AVRO_HIVE))]
    assert sorted((r.ordinal, r.name, r.type) for r in rows if r.file.endswith("p.avro")) == want


def test_avsc_next_to_the_folder(folder):
    path = write_avro(f"{folder}/top/data/p.avro")
    target = S.write_avsc(path)
    assert target == f"{folder}/top/p.avsc"
    with open(target) as text:
        assert json.load(text) == AVRO
    write(target, "mine")
    S.write_avsc(path)
    with open(target) as text:
        assert text.read() == "mine"


def test_no_avro_container(spark, folder):
    path = write(f"{folder}/x.avro", "hello")
    with pytest.raises(ValueError):
        S.avro_schema_json(path)


def test_external_tables(spark, folder):
    spark.range(5).select("id", F.lit("x").alias("row_id")).write.parquet(f"{folder}/p")
    df = S.register_external(spark, "default", "sites_p", f"{folder}/p", "parquet")
    assert (df.count(), df.columns) == (5, ["id", "row_id"])
    path = write(f"{folder}/c/sites.csv", "site_id,row_id\n1,a\n2,b\n")
    df = S.register_external(spark, "default", "sites_c", path)
    assert [tuple(r) for r in df.orderBy("site_id").collect()] == [(1, "a"), (2, "b")]
    assert dict(df.dtypes) == {"site_id": "int", "row_id": "string"}
    with pytest.raises(Exception, match="already exists"):
        S.register_external(spark, "default", "sites_c", path)
    with pytest.raises(ValueError, match="extension"):
        S.register_external(spark, "default", "sites_x", f"{folder}/c/sites.xlsx")
    for name in ("sites_p", "sites_c"):
        spark.sql(f"DROP TABLE {name}")
    assert os.path.exists(path)  # the data outlives the table


def test_parquet_of_another_writer(spark, folder):
    pa = pytest.importorskip("pyarrow")
    import pyarrow.parquet as pq

    table = pa.table(
        {
            "u8": pa.array([1], pa.uint8()), "u64": pa.array([1], pa.uint64()),
            "at": pa.array([dt.datetime(2024, 1, 1)], pa.timestamp("ms", "UTC")),
            "wall": pa.array([dt.datetime(2024, 1, 1)], pa.timestamp("us")),
            "d": pa.array([decimal.Decimal("1.5")], pa.decimal128(9, 2)),
            "s": pa.array([{"x": [1], "m": [("k", 1.5)]}],
                          pa.struct([("x", pa.list_(pa.int16())), ("m", pa.map_(pa.string(), pa.float64()))])),
        }
    )
    for name, old in (("a", False), ("b", True)):
        pq.write_table(table, f"{folder}/{name}.parquet", use_deprecated_int96_timestamps=old)
        path = f"{folder}/{name}.parquet"
        want = S.hive_columns(spark.read.parquet(path).schema)
        assert described(S.describe_files(spark, path, "parquet")) == want


def test_every_given_table_is_described(spark):
    contract = pytest.importorskip("__spark_entry__")
    if not os.path.isdir(contract.SMOKE_DIR):
        pytest.skip("no test tables")
    want = {}
    for file in os.listdir(contract.SMOKE_DIR):
        if file.endswith(".parquet"):
            schema = spark.read.parquet(f"{contract.SMOKE_DIR}/{file}").schema
            want |= {(file.removesuffix(".parquet"), i): (n, t, None) for i, n, t in S.hive_columns(schema)}
    got = contract.queries()["infer_parquet_schema"](spark, contract.SMOKE_DIR).collect()
    assert {(r.table_name, r.ordinal): (r["name"], r.type, r.error) for r in got} == want
    assert len(got) == len(want) and want[("embeddings", 1)][1].startswith("array<")


def test_files_of_any_name_are_described(spark, folder):
    spark.range(3).coalesce(1).write.parquet(f"{folder}/p")
    part = next(f for f in os.listdir(f"{folder}/p") if f.endswith(".parquet"))
    for name in ("000000_0", "UP.PARQUET"):
        with open(f"{folder}/p/{part}", "rb") as given, open(f"{folder}/p/{name}", "wb") as out:
            out.write(given.read())
    write(f"{folder}/p/notes.txt", "hello")
    rows = {r.file.rsplit("/", 1)[1]: (r.name, r.error is None) for r in S.describe_files(spark, f"{folder}/p", "parquet").collect()}
    assert rows == {part: ("id", True), "000000_0": ("id", True), "UP.PARQUET": ("id", True), "notes.txt": (None, False)}
    assert S.describe_files(spark, f"{folder}/p/000000_0", "parquet").count() == 1
