"""Files in and out."""

import io
import json
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import text as tx
from quernstone.sources import files, normalise, snapshots, workbooks


def test_json_shapes(spark, tmp_path):
    for name, content in {"a": [{"x": 1}], "b": {"data": [{"x": 2}]}, "c": {"data": {"results": [{"x": 3}]}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    got = files.read_json(spark, str(tmp_path), T.StructType([T.StructField("x", T.IntegerType())]))
    assert sorted(r.x for r in got.collect()) == [1, 2, 3]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nx,"two\nlines, ""quoted"""\n')
    assert [(r.name, r.note) for r in files.read_csv(spark, str(tmp_path)).collect()] == [("x", 'two\nlines, "quoted"')]


def test_geojson(spark, tmp_path):
    shapes = [
        {"type": "Point", "coordinates": [35.0, 31.0]},
        {"type": "LineString", "coordinates": [[0, 0], [1, 2], [3, 3]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]},
    ]
    doc = {"type": "FeatureCollection", "features": [{"geometry": g, "properties": {"n": i}} for i, g in enumerate(shapes)]}
    (tmp_path / "x.geojson").write_text(json.dumps(doc))
    got = {r.kind: (r.lat, r.lon) for r in files.read_geojson(spark, str(tmp_path)).collect()}
    assert got == {"Point": (31.0, 35.0), "LineString": (2.0, 1.0), "Polygon": (1.0, 2.0)}


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[A &amp; B]]></title><guid>1</guid><link>http://x</link><description>&lt;p&gt;hi</description></item></rss>"
    atom = '<feed><entry><id>2</id><title>T</title><link rel="alternate" href="http://y"/><updated>2024</updated></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, None)], "k int, x string")
    got = {r.guid: (r.title, r.link) for r in files.feed_items(df, "x", "k").collect()}
    assert got == {"1": ("A & B", "http://x"), "2": ("T", "http://y")}


def test_delta_rows(spark):
    rows = [("t", 0, ["a", "b"], 0, 0), ("t", 1, ["c"], 1, 0), ("t", 2, [], 2, 1), ("t", 3, ["d"], 1, 0)]
    df = spark.createDataFrame(rows, "t string, i int, v array<string>, r int, n int")
    got = files.decode_delta_rows(df, "t", "i", "v", "r", "n", ["x", "y"]).orderBy("i").collect()
    assert [(r.x, r.y) for r in got] == [("a", "b"), ("a", "c"), (None, "c"), (None, "d")]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    snapshots.write_snapshot(df, path, "2024-01-01")
    snapshots.write_snapshot(df.filter("x = 1"), path, "2024-02-01")
    assert snapshots.read_snapshot(spark, path, "2024-01-15").count() == 2
    assert snapshots.read_snapshot(spark, path, "2024-02-15").count() == 1
    assert snapshots.read_snapshot(spark, path, "2023-01-01").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 31.0, 35.0), (2, None, 35.0)], "id int, lat double, lon double")
    files.write_geojson(df, str(tmp_path / "g"), "id")
    assert spark.read.text(str(tmp_path / "g")).count() == 1
    files.write_gzip_json(df, str(tmp_path / "z"))
    assert spark.read.json(str(tmp_path / "z")).count() == 2
    files.export(df, str(tmp_path / "e"), "id", "csv")
    assert files.read_csv(spark, str(tmp_path / "e")).count() == 2
    dated = spark.range(20).withColumn("date", F.lit("2024-05-01").cast("date"))
    snapshots.write_partitioned(dated, str(tmp_path / "p"), least=10)
    assert spark.read.parquet(str(tmp_path / "p")).filter("quarter = '2024-Q2'").count() == 20


def test_normalise(spark):
    df = spark.createDataFrame([("", "5,000", "2024"), ("b", "n/a", "x")], "alt string, n string, d string")
    got = normalise.normalised(df, {"name": ("name", "alt"), "count": ("n",), "date": ("d",), "none": ("zz",)}, ("count",), ("date",)).collect()
    assert [(r.name, r["count"], str(r.date), r.none) for r in got] == [(None, 5000.0, "2024-01-01", None), ("b", None, "None", None)]


def test_workbooks(spark, tmp_path):
    rows = [("x & <y>", 45292, 1.5), (None, None, None), (" two\nlines", None, -2)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.xlsx").write_bytes(workbooks.workbook(["note", "date", "note", None, "last"], [(*r, "unnamed", name) for r in rows]))
    (tmp_path / "other.txt").write_text("no workbook")
    got = workbooks.read_workbooks(spark, str(tmp_path)).orderBy("path", "row").collect()
    assert [r.row for r in got] == [1, 2, 3] * 2
    assert got[0].cells == {"note": "x & <y>", "date": "45292", "note_1": "1.5", "__EMPTY": "unnamed", "last": "a"}
    assert got[1].cells == {"note": None, "date": None, "note_1": None, "__EMPTY": "unnamed", "last": "a"}
    assert got[5].cells["note"] == " two\nlines" and got[5].cells["date"] is None
    assert workbooks.read_workbooks(spark, str(tmp_path), "Sheet1").count() == 6


def test_workbook_cells():
    book = workbooks.workbook(["a", "b"], [("1", 2)])
    parts = {}
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row/>'
        '<row><c t="inlineStr"><is><r><t>na</t></r><r><t>me</t></r></is></c><c r="AB2" t="str"><v>far</v></c></row><row/>'
        '<row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c r="AB4"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, content in parts.items():
            z.writestr(n, content)
    (row,) = workbooks.sheet_records(out.getvalue())
    assert (row["name"], row["__EMPTY"], row["far"], len(row)) == ("true", None, "2", 28)


def test_csv_line(spark):
    df = spark.createDataFrame([('a "b",\nc', None)], "x string, y int")
    assert df.select(tx.csv_line(F.col("x"), F.col("y")).alias("l")).first().l == '"a ""b"", c",""'
