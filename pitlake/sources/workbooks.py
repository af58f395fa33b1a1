"""Spreadsheet workbooks as a Spark data source: rows streamed from the XML, large sheets in several partitions.

    register(spark)
    spark.read.format("workbook").schema("code string, close string").option("path", folder).load()

Options: path (a workbook or a folder), skipRows (rows after the header that describe it), sheet (a name;
default all), aliases (JSON of column -> list of headers), splitBytes (of a sheet's XML to a partition, 64 MB). Columns are found by
header; a header that is missing fails the read. Cells come as strings; ``pitlake.functions.columns`` parses them.
Special columns: source_file, source_row, and source_year (int), the year in a workbook's name.

Only cells of the schema's columns are made. Comparisons of source_year
decide which workbooks are opened, and equalities of string columns (``code IN (...)``) which rows leave the reader. A
partition takes the rows that begin in its range of the sheet's XML: it inflates what comes before and parses none of it.
"""

from __future__ import annotations

import json
import operator
import re
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_index(ref: str) -> int:
    """0 for A, 26 for AA, from a cell reference such as AA7."""
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in e.iter(f"{_MAIN}t")) for _, e in ElementTree.iterparse(f) if e.tag == f"{_MAIN}si"]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return [(s.get("name"), "xl/" + links[s.get(_REL)].removeprefix("/xl/")) for s in sheets]


_OPENS = re.compile(rb"<(?:\w+:)?row(?=[\s/>])")
_CLOSES = re.compile(rb"</(?:\w+:)?row\s*>")
_PREFIX = re.compile(rb"<(/?)\w+:")


def _fragments(stream, start: int, end: int | None, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The XML of each row that begins at a byte from ``start`` on and before ``end``."""
    base, held = 0, b""  # the place of the first byte held
    while True:
        opened = _OPENS.search(held, max(0, start - base))
        if opened and end is not None and base + opened.start() >= end:
            return
        closed = None
        if opened:
            head = held.find(b">", opened.end())
            if head >= 0:
                closed = head + 1 if held[head - 1 : head] == b"/" else (m.end() if (m := _CLOSES.search(held, head)) else None)
        if closed:
            yield held[opened.start() : closed]
            start = base + closed
            continue
        more = stream.read(chunk)
        if not more:
            return
        # What lies before the row that is being read, or too far back to be the beginning of one, is not needed any more.
        drop = opened.start() if opened else max(0, len(held) - 64)
        base, held = base + drop, held[drop:] + more


def _cells(fragment: bytes, strings: list[str], wanted: set[int] | None) -> tuple[int, list[str | None]]:
    """Row number and cells; only those of the wanted columns have a value."""
    row = ElementTree.fromstring(_PREFIX.sub(rb"<\1", fragment))
    cells: list[str | None] = []
    for c in row.iter("c"):
        at = column_index(c.get("r")) if c.get("r") else len(cells)
        cells += [None] * (at + 1 - len(cells))
        if wanted is not None and at not in wanted:
            continue
        v = c.find("v")
        if c.get("t") == "inlineStr":
            cells[at] = "".join(t.text or "" for t in c.iter("t"))
        elif v is not None and v.text is not None:
            cells[at] = strings[int(v.text)] if c.get("t") == "s" else v.text
    return int(row.get("r", 0)), cells


def rows_of(path: str, sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook; gaps in a row are None."""
    with zipfile.ZipFile(path) as book:
        strings = _strings(book)
        for name, part in _sheets(book):
            if sheet and name != sheet:
                continue
            with book.open(part) as f:
                for n, fragment in enumerate(_fragments(f, 0, None), 1):
                    number, cells = _cells(fragment, strings, None)
                    yield name, number or n, cells


def discover(path: str, years: range | None = None) -> list[str]:
    """Workbooks under a path in natural order, without lock files; a year in the name may be asked for."""
    root = Path(path)
    found = [root] if root.is_file() else [p for p in root.rglob("*.xlsx") if not p.name.startswith("~$")]
    if years is not None:
        found = [p for p in found if (m := re.search(r"(19|20)\d\d", p.stem)) and int(m[0]) in years]
    return sorted(map(str, found), key=lambda s: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", s)])


def year_of(path: str) -> int | None:
    found = re.search(r"(?:19|20)\d\d", Path(path).stem)
    return int(found[0]) if found else None


class _Part(InputPartition):
    """Rows of one sheet that begin in a range of its XML's bytes."""

    def __init__(self, path: str, sheet: str, part: str, start: int, end: int | None):
        self.path, self.sheet, self.part, self.start, self.end = path, sheet, part, start, end


_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_SPECIAL = ("source_file", "source_row", "source_year")


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.strings = {f.name for f in schema.fields if f.dataType.typeName() == "string"} - set(_SPECIAL)
        self.path = options["path"]
        self.skip = int(options.get("skiprows", options.get("skipRows", 0)))
        self.sheet = options.get("sheet")
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.aliases = {k: list(v) for k, v in json.loads(options.get("aliases", "{}")).items()}
        self.years: list[Filter] = []
        self.equal: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name == "source_year" and type(f) in (*_COMPARED, In):
                self.years.append(f)
            elif name in self.strings and type(f) in (EqualTo, In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.equal[name] = self.equal.get(name, values) & values
            else:
                yield f

    def _asked(self, path: str) -> bool:
        year = year_of(path)
        return all(year is not None and (year in f.value if isinstance(f, In) else _COMPARED[type(f)](year, f.value)) for f in self.years)

    def partitions(self):
        out = []
        for path in filter(self._asked, discover(self.path)):
            with zipfile.ZipFile(path) as book:
                for name, part in _sheets(book):
                    if self.sheet and name != self.sheet:
                        continue
                    count = max(1, -(-book.getinfo(part).file_size // self.split))
                    out += [_Part(path, name, part, k * self.split, (k + 1) * self.split if k + 1 < count else None) for k in range(count)]
        return out or [_Part("", "", "", 0, 0)]  # Spark wants one at least

    def _header(self, fragments: Iterator[bytes], strings: list[str], at: _Part) -> tuple[list, int]:
        """What each column is, and how many rows up to the header there are; a sheet without any row has no columns."""
        for n, fragment in enumerate(fragments, 1):
            _, cells = _cells(fragment, strings, None)
            if not any(cells):
                continue
            names = {str(c).strip(): i for i, c in enumerate(cells) if c is not None}
            header: list = []
            for column in self.columns:
                hit = column if column in _SPECIAL else next((names[a] for a in [column, *self.aliases.get(column, [])] if a in names), None)
                if hit is None:
                    raise ValueError(f"{at.path}, {at.sheet}: no header for {column}")
                header.append(hit)
            return header, n
        return [], 0

    def read(self, partition):
        if not partition.path:
            return
        with zipfile.ZipFile(partition.path) as book:
            strings = _strings(book)
            with book.open(partition.part) as f:
                header, before = self._header(_fragments(f, 0, None), strings, partition)
            if not header:
                return
            wanted = {h for h in header if isinstance(h, int)}
            tests = [(h, self.equal[c]) for c, h in zip(self.columns, header, strict=True) if c in self.equal]
            skip = before + self.skip if partition.start == 0 else 0
            skipped = self._first_bytes(book, partition, before + self.skip) if partition.start else 0
            with book.open(partition.part) as f:
                for n, fragment in enumerate(_fragments(f, max(partition.start, skipped), partition.end), 1):
                    if n <= skip:
                        continue
                    number, cells = _cells(fragment, strings, wanted)
                    at = lambda h, cells=cells: cells[h] if h < len(cells) else None
                    if not any((v := at(h)) is not None and str(v).strip() for h in wanted) or any(at(h) not in values for h, values in tests):
                        continue
                    special = {"source_file": partition.path, "source_row": str(number or (n if partition.start == 0 else 0)), "source_year": year_of(partition.path)}
                    yield tuple(special[h] if isinstance(h, str) else at(h) for h in header)

    def _first_bytes(self, book: zipfile.ZipFile, partition: _Part, rows: int) -> int:
        """A place behind the rows up to the header and those that describe it, which may reach into a later range."""
        with book.open(partition.part) as f:
            data, n = b"", 0
            while n < rows and (more := f.read(1 << 16)):
                data += more
                n = len(_CLOSES.findall(data))
            ends = [m.end() for m in _CLOSES.finditer(data)]
        return ends[min(rows, len(ends)) - 1] if ends else 0


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
