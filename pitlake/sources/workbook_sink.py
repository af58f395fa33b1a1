"""Tables as spreadsheets: first row frozen and filtered, column widths by content.

    spark.dataSource.register(WorkbookSink)
    df.write.format("workbook_sink").mode("overwrite").option("path", "/shared/report.xlsx").option("sheet", "Positions").save()

Tasks write the rows of their partitions as fragments of a sheet into a folder beside the workbook, which driver and executors
share; the commit joins the fragments, in order of partitions, into the workbook and moves it into place. What reaches the driver from tasks
is a message each: the fragment's name, its rows and widths. ``write_workbook`` does so for several tables and joins all of them.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_575  # what a sheet takes besides its header


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook takes: 31 characters at most, without signs it refuses, different in any case."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", n)[:31] or "Sheet1"
        name, k = base, 1
        while name.lower() in {o.lower() for o in out}:
            k += 1
            name = f"{base[: 31 - len(str(k)) - 1]}_{k}"
        out.append(name)
    return out


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cell(v: object) -> str:
    """A cell without its reference: cells follow each other, so a missing value is an empty cell."""
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"<c><v>{v}</v></c>" if isinstance(v, decimal.Decimal) else f"<c><v>{v!r}</v></c>"
    s = v.isoformat(" ") if isinstance(v, dt.datetime) else str(v)
    s = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", s)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(s)}</t></is></c>'


def _row(values: Iterable) -> str:
    return "<row>" + "".join(map(_cell, values)) + "</row>"


@dataclass
class Fragment(WriterCommitMessage):
    """What a task has written."""

    partition: int
    path: str
    rows: int
    widths: list[int]


def _copy(source: str, target) -> None:
    with open(source, "rb") as f:
        while piece := f.read(1 << 20):
            target.write(piece)


def _sheet(book: zipfile.ZipFile, part: str, columns: list[str], fragments: list[Fragment]) -> None:
    rows = sum(f.rows for f in fragments)
    if rows > MOST_ROWS:
        raise ValueError(f"a sheet takes {MOST_ROWS} rows, not {rows}")
    width = [min(40, max([len(c), *[f.widths[i] for f in fragments]]) + 2) for i, c in enumerate(columns)]
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(width))
    with book.open(part, "w", force_zip64=True) as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>{_row(columns)}'.encode())
        for fragment in sorted(fragments, key=lambda f: f.partition):
            _copy(fragment.path, out)
        out.write(f'</sheetData><autoFilter ref="A1:{_letters(max(len(columns) - 1, 0))}{rows + 1}"/></worksheet>'.encode())


def _join(path: str, sheets: dict[str, tuple[list[str], list[Fragment]]]) -> None:
    """The workbook of some sheets (columns, fragments), made beside ``path`` and moved there whole."""
    names, count = sheet_names(list(sheets)), range(1, len(sheets) + 1)
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with zipfile.ZipFile(fresh, "w", zipfile.ZIP_DEFLATED) as book:
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in count)
            book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                          f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')  # fmt: skip
            book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in count) + "</Relationships>")
            book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(count, names, strict=True)) + "</sheets></workbook>")
            for i, (columns, fragments) in zip(count, sheets.values(), strict=True):
                _sheet(book, f"xl/worksheets/sheet{i}.xml", columns, fragments)
        os.replace(fresh, path)
    finally:
        if os.path.exists(fresh):
            os.remove(fresh)


class _Writer(DataSourceWriter):
    def __init__(self, columns: list[str], options: dict, overwrite: bool):
        self.columns, self.path, self.sheet, self.overwrite = columns, options["path"].removeprefix("file://"), options.get("sheet", "Sheet1"), overwrite
        #: Fragments alone, to be joined by who asked for them.
        self.keep = options.get("fragments", "")
        self.folder = self.keep or f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator) -> Fragment:
        context = TaskContext.get()
        path = os.path.join(self.folder, f"{context.partitionId():08d}-{context.taskAttemptId()}.xml")
        rows, widths = 0, [0] * len(self.columns)
        with open(path, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(_row(row))
                rows += 1
                widths = [max(w, len(str(v))) if v is not None else w for w, v in zip(widths, row, strict=True)]
        return Fragment(context.partitionId(), path, rows, widths)

    def commit(self, messages: list) -> None:
        fragments = [m for m in messages if m is not None]
        if self.keep:  # a list of what counts, as failed attempts may have left files
            with open(os.path.join(self.folder, "fragments.json"), "w") as f:
                json.dump([[m.partition, m.path, m.rows, m.widths] for m in fragments], f)
            return
        try:
            if not self.overwrite and os.path.exists(self.path):
                raise ValueError(f"{self.path} is there already; use mode overwrite")
            _join(self.path, {self.sheet: (self.columns, fragments)})
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        writer = _Writer([f.name for f in schema.fields], self.options, overwrite)
        os.makedirs(writer.folder, exist_ok=True)  # here and not in tasks, so that those that end late find none
        return writer


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Several tables as one workbook, a sheet each; ``path`` is on a file system that driver and executors share."""
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    made: dict[str, tuple[list[str], list[Fragment]]] = {}
    try:
        for i, (name, df) in enumerate(sheets.items()):
            df.sparkSession.dataSource.register(WorkbookSink)
            own = os.path.join(folder, str(i))
            os.makedirs(own)
            df.write.format("workbook_sink").mode("append").options(path=path, fragments=own).save()
            with open(os.path.join(own, "fragments.json")) as f:
                made[name] = df.columns, [Fragment(*x) for x in json.load(f)]
        _join(path, made)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
