"""Workbooks written by hand, read in parts."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.sources.workbooks import register

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _sheet(rows, dimension=True):
    body = "".join(f'<row r="{i}">' + "".join(c for c in r) + "</row>" for i, r in enumerate(rows, 1))
    return f"<worksheet {NS}>" + (f'<dimension ref="A1:D{len(rows)}"/>' if dimension else "") + f"<sheetData>{body}</sheetData></worksheet>"


def workbook(path, n=25):
    """Two sheets: shared and inline strings, numbers, booleans, dates, gaps and an error; the second has no dimension."""
    text = lambda at, i: f'<c r="{at}" t="s"><v>{i}</v></c>'
    num = lambda at, v, s=0: f'<c r="{at}" s="{s}"><v>{v}</v></c>'
    head = [text("A1", 0), text("B1", 1), text("C1", 2), '<c r="D1" t="inlineStr"><is><t>ok</t></is></c>']
    rows = [head] + [[num(f"A{i}", i * 1.5), num(f"B{i}", 45000 + i / 4, 1), *([text(f"C{i}", 3 + i % 2)] if i % 5 else []), f'<c r="D{i}" t="b"><v>{i % 2}</v></c>' if i % 7 else f'<c r="D{i}" t="e"><v>#N/A</v></c>'] for i in range(2, n + 2)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="x"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>price</t></si><si><t>at</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>even</t></si><si><t>odd</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", _sheet(rows))
        z.writestr("xl/worksheets/b.xml", _sheet(rows[:4], dimension=False))


def test_workbook_in_parts(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    workbook(path)
    register(spark)
    df = spark.read.format("workbook").option("rows", 10).load(path)
    assert dict(df.dtypes) == {"price": "double", "at": "timestamp", "name": "string", "ok": "boolean", "_sheet": "string"}
    assert df.rdd.getNumPartitions() == 3
    rows = sorted(df.collect(), key=lambda r: r.price)
    assert len(rows) == 25 and rows[0] == (3.0, dt.datetime(2023, 3, 15) + dt.timedelta(hours=12), "even", False, "One")
    assert rows[3].name is None and rows[5].ok is None
    both = spark.read.format("workbook").option("sheet", "*").load(f"{tmp_path}/*.xlsx")
    assert {r._sheet: r.n for r in both.groupBy("_sheet").agg(F.count("*").alias("n")).collect()} == {"One": 25, "Two": 3}
    assert spark.read.format("workbook").schema("price double, name string").load(path).where("price > 30").count() == sum(r.price > 30 for r in rows)


def test_filters_reach_the_reader(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    workbook(path)
    register(spark)
    df = spark.read.format("workbook").load(path).where("price >= 9 and name = 'odd' and price is not null")
    assert {r.price for r in df.collect()} == {i * 1.5 for i in range(6, 27) if i % 5 and i % 2}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan  # every condition is the reader's


def test_load(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    workbook(path)
    assert files.load(spark, path, limit=2, order="price").count() == 2
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"{tmp_path}/none.xlsx")
    with pytest.raises(ValueError):
        files.load(spark, f"{tmp_path}/old.xls")
