"""Files in, lines out."""

import io

import pytest

from millrace.__main__ import main
from millrace.engine import Engine
from millrace.errors import SourceProblem
from millrace.sinks import csvlines, formatter, jsonl
from millrace.sources.schema_info import column_infos, schema_table
from millrace.streaming import tail


@pytest.fixture
def folder(spark, tmp_path):
    for i in (1, 2, 3):
        spark.createDataFrame([(i, f"n{i}")], "id long, name string").coalesce(1).write.parquet(str(tmp_path / f"file{i}.parquet"))
    return tmp_path


def test_glob(spark, folder):
    got = Engine(spark, str(folder)).sql("SELECT _file, id FROM 'file*.parquet' ORDER BY id").collect()
    assert [r["id"] for r in got] == [1, 2, 3]
    assert all(r["_file"].startswith(str(folder)) for r in got)
    braces = Engine(spark, str(folder)).sql("SELECT COUNT(*) AS n FROM 'file{1,2}.parquet'").collect()
    assert braces[0]["n"] == 2


def test_glob_join_names_files(spark, folder):
    e = Engine(spark, str(folder))
    df = e.sql("SELECT _file_left, _file_right FROM 'file*.parquet' a JOIN 'file*.parquet' b ON a.id = b.id")
    assert df.count() == 3


def test_glob_of_differing_columns(spark, folder):
    spark.createDataFrame([(4, 1.5)], "id long, more double").write.parquet(str(folder / "file4.parquet"))
    assert Engine(spark, str(folder)).sql("SELECT id FROM 'file*.parquet' WHERE more IS NULL").count() == 3


def test_unreadable(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(SourceProblem):
        Engine(spark).table(str(tmp_path / "x.parquet"))
    with pytest.raises(SourceProblem):
        column_infos(str(tmp_path / "x.parquet"))


def test_schema(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    spark.sql("SELECT 1L AS id, 'a' AS name, 2 AS i, 1.5D AS d, true AS b, named_struct('street', 's', 'city', 'c') AS address, array('x') AS tags, date'2024-01-01' AS day, cast(1.5 as decimal(9,2)) AS price").coalesce(1).write.parquet(path)
    infos = {c.name: c for c in column_infos(path)}
    assert {n: c.type for n, c in infos.items()} == {
        "id": "INT64", "name": "STRING", "i": "INT32", "d": "FLOAT64", "b": "BOOLEAN", "address.street": "STRING", "address.city": "STRING", "tags": "STRING", "day": "DATE", "price": "DECIMAL",
    }
    assert infos["tags"].repeated and not infos["tags"].optional
    assert schema_table(spark, path).count() == len(infos)


def test_json(spark):
    df = spark.createDataFrame([("x", None, [1, 2])], "b string, a int, c array<int>")
    assert list(jsonl.iterate(df)) == ['{"a":null,"b":"x","c":[1,2]}']


def test_csv(spark):
    df = spark.createDataFrame([("=1+'2", 5.0, None, 'say "hi", you'), ("plain", 2.5, True, "two\nlines")], "f string, n double, b boolean, q string")
    assert list(csvlines.iterate(df)) == ["b,f,n,q", ",'=1+''2,5,\"say \"\"hi\"\", you\"", "true,plain,2.5,\"two\nlines\""]
    assert list(csvlines.iterate(df.limit(0))) == []


def test_saved(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    jsonl.save(df, str(tmp_path / "j"))
    csvlines.save(df, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "j")).collect()[0][0] == '{"i":1,"s":"a"}'
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0]["s"] == "a"


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    return main(list(argv), spark=spark, out=out, err=err), out.getvalue(), err.getvalue()


def test_command_line(spark, folder):
    one = str(folder / "file1.parquet")
    assert run(spark, one) == (0, '{"id":1,"name":"n1"}\n', "")
    assert run(spark, "-q", "select name from other.parquet where id = 1", one)[1] == '{"name":"n1"}\n'
    assert run(spark, "-f", "csv", "-limit", "1", str(folder / "file*.parquet"))[1].startswith("_file,id,name\n")
    assert len(run(spark, "-q", "select id from x limit 3", "-limit", "1", str(folder / "file*.parquet"))[1].splitlines()) == 3
    code, out, err = run(spark, "--schema", str(folder / "file*.parquet"))
    assert code == 0 and '"name":"id"' in out and "first file" in err
    assert run(spark, "-limit", "-1", one)[0] == 1
    assert "cannot be used together" in run(spark, "--schema", "-q", "select a from b", one)[2]
    assert "unsupported format" in run(spark, "-f", "xml", one)[2]
    assert "no such file" in run(spark, "/nowhere.parquet")[2]
    assert run(spark, "-q", "with c as (select id from '%s') select id from c" % one, one)[1] == '{"id":1}\n'


def test_formatter():
    assert formatter("json") is formatter("jsonl")


def test_stream(spark, folder, tmp_path):
    engine = Engine(spark)
    tail.stream_table(engine, "s", str(folder / "file*.parquet"), schema=spark.read.parquet(str(folder / "file1.parquet")).schema)
    query = tail.start(engine.sql("SELECT id, UPPER(name) AS n FROM s WHERE id > 1"), str(tmp_path / "out"), str(tmp_path / "chk"))
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["N2", "N3"]
