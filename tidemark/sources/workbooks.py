"""Workbooks (xlsx) as a partitioned Spark source: one part for each file, sheet and range of rows.

    register(spark)
    spark.read.format("workbook").option("sheet", "*").option("rows", 50_000).load("/shared/*.xlsx")

The path (a glob may match many) must be readable by the driver and all executors, as with a mounted store. A sheet's first
row names the columns. Without a schema the types come from the first rows of the first sheet: numbers are double, dates timestamps,
booleans boolean, the rest strings; `_sheet` tells the sheet. Comparisons of columns with literals are applied while a
part is read, for which the source needs spark.sql.python.filterPushdown.enabled; register() sets it.
"""

from __future__ import annotations

import glob
import operator
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType, TimestampType

# The built-in number formats that show dates, and the day that serial numbers count from.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
DAY_ZERO = datetime(1899, 12, 30)
TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The strings that cells share by number."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if _tag(e) == "si":
                out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
                e.clear()
    return out


def _dated(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    own, styles, inside = {}, [], False
    with book.open("xl/styles.xml") as f:
        for event, e in iterparse(f, ("start", "end")):
            if _tag(e) == "cellXfs":
                inside = event == "start"
            elif event == "start" and _tag(e) == "numFmt":
                own[int(e.get("numFmtId"))] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower()
            elif event == "start" and inside and _tag(e) == "xf":
                styles.append(int(e.get("numFmtId", 0)))
    return {i for i, n in enumerate(styles) if n in DATE_FORMATS or re.search("[ymdhs]", own.get(n, ""))}


def sheets(path: str) -> dict[str, str]:
    """The sheets' names and their files within the workbook, in their order."""
    with zipfile.ZipFile(path) as book:
        with book.open("xl/_rels/workbook.xml.rels") as f:
            target = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if _tag(e) == "Relationship"}
        with book.open("xl/workbook.xml") as f:
            found = [(e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))) for _, e in iterparse(f) if _tag(e) == "sheet"]
    return {name: t.lstrip("/") if (t := target[i]).startswith("/") else f"xl/{t}" for name, i in found}


def _height(path: str, sheet: str) -> int | None:
    """The last row that the sheet says it has."""
    with zipfile.ZipFile(path) as book, book.open(sheet) as f:
        for event, e in iterparse(f, ("start",)):
            if _tag(e) == "dimension":
                last = re.search(r"(\d+)$", e.get("ref", ""))
                return int(last[1]) if last else None
            if _tag(e) == "sheetData":
                return None


def cells(path: str, sheet: str, first: int, last: int | None) -> Iterator[dict[int, object]]:
    """Rows `first` to `last` (from 1) as {column from 0: value}."""
    with zipfile.ZipFile(path) as book:
        shared, dated = _texts(book), _dated(book)
        with book.open(sheet) as f:
            at = 0
            for event, e in iterparse(f, ("start", "end")):
                if _tag(e) != "row":
                    continue
                if event == "start":
                    at = int(e.get("r") or at + 1)
                    if last is not None and at > last:
                        return
                    continue
                if at >= first:
                    yield _row(e, shared, dated)
                e.clear()


def _row(e, shared: list[str], dated: set[int]) -> dict[int, object]:
    out: dict[int, object] = {}
    at = -1
    for c in e:
        letters = re.match("[A-Z]+", c.get("r", ""))
        at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else at + 1
        kind = c.get("t", "n")
        text = "".join(t.text or "" for t in c.iter() if _tag(t) == ("t" if kind == "inlineStr" else "v"))
        if kind == "e" or (not text and kind != "inlineStr"):
            continue
        if kind == "s":
            out[at] = shared[int(text)]
        elif kind in ("str", "inlineStr", "d"):
            out[at] = text
        elif kind == "b":
            out[at] = text == "1"
        else:
            out[at] = DAY_ZERO + timedelta(microseconds=round(float(text) * 86_400_000_000)) if int(c.get("s", 0)) in dated else float(text)
    return out


class Part(InputPartition):
    def __init__(self, path: str, name: str, sheet: str, first: int, last: int | None):
        self.path, self.name, self.sheet, self.first, self.last = path, name, sheet, first, last


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _parts(self) -> list[tuple[str, str, str]]:
        path, wanted = self.options["path"].removeprefix("file://"), self.options.get("sheet")
        found = [(p, n, s) for p in sorted(glob.glob(path)) for i, (n, s) in enumerate(sheets(p).items()) if wanted in ("*", n) or (wanted is None and i == 0)]
        if not found:
            raise FileNotFoundError(f"no workbook or sheet: {path}")
        return found

    def schema(self) -> StructType:
        path, _, sheet = self._parts()[0]
        rows = list(cells(path, sheet, 1, 101))
        head, kinds = rows[0] if rows else {}, []
        for i in sorted(head):
            seen = {type(r[i]) for r in rows[1:] if i in r}
            kind = {frozenset({float}): DoubleType(), frozenset({bool}): BooleanType(), frozenset({datetime}): TimestampType()}.get(frozenset(seen), StringType())
            kinds.append(StructField(str(head[i]), kind))
        return StructType([*kinds, StructField("_sheet", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema, self._parts(), int(self.options.get("rows", 50_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, found: list[tuple[str, str, str]], rows: int):
        self.schema, self.found, self.rows, self.tests = schema, found, rows, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], TESTS[type(f)], f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], lambda v, _: v is not None, None))
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for path, name, sheet in self.found:
            height = _height(path, sheet)
            starts = range(2, height + 1, self.rows) if height else [2]
            out += [Part(path, name, sheet, a, a + self.rows - 1 if height and a + self.rows <= height else None) for a in starts]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        head = next(cells(part.path, part.sheet, 1, 1), {})
        place = {str(v): i for i, v in head.items()}
        for row in cells(part.path, part.sheet, part.first, part.last):
            if not row:
                continue
            out = tuple(part.name if f.name == "_sheet" else _as(row.get(place.get(f.name, -1)), f.dataType) for f in self.schema)
            told = dict(zip(self.schema.names, out))
            if all(told[c] is not None and test(told[c], v) for c, test, v in self.tests):
                yield out


def _as(v, kind):
    """A cell as the schema wants it; what can't be is null."""
    if v is None or isinstance(kind, StringType):
        return None if v is None else v if isinstance(v, str) else str(v)
    want = {DoubleType: float, BooleanType: bool, TimestampType: datetime}.get(type(kind))
    if want is float and isinstance(v, str):
        try:
            return float(v)
        except ValueError:
            return None
    return v if want and isinstance(v, want) and not (want is float and isinstance(v, bool)) else None
