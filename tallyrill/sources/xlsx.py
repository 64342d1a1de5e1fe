"""Workbooks without an office library: a data source named ``xlsx`` that reads and writes, and a styled writer.

A partition of a scan is a range of rows of one workbook's sheet: a sheet is one compressed stream, which each of its partitions
inflates up to its last row, but only rows of its own range are taken apart.  With the option ``pushdown`` a scan is
given the filters of a query, and takes apart only the filtered cells of a row until they hold.  A folder or a list of paths gives
all their workbooks.

A write makes one workbook a partition (``part-...xlsx`` in a folder), in a hidden folder first; they are moved to their place when
all tasks have ended, and a failed write leaves nothing.  Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import io
import re
import shutil
import tempfile
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(MAIN + "t"))


class Sheet:
    """One sheet of a workbook, by position or by name."""

    def __init__(self, book: bytes, sheet: str | int = 0) -> None:
        self.book = zipfile.ZipFile(io.BytesIO(book))
        names = set(self.book.namelist())
        self.shared = [_text(si) for si in ET.fromstring(self.book.read("xl/sharedStrings.xml")).iter(MAIN + "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(LINK)]) for s in ET.fromstring(self.book.read("xl/workbook.xml")).iter(MAIN + "sheet")]
        chosen = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets).get(sheet)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
        self.member = chosen.lstrip("/") if chosen.startswith("/") else "xl/" + chosen

    def value(self, c: ET.Element) -> str | None:
        v, kind = c.find(MAIN + "v"), c.get("t")
        if kind == "inlineStr":
            return _text(c)
        if v is None or v.text is None:
            return None
        return self.shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text

    def cells(self, row: ET.Element) -> list[str | None]:
        cells: list[str | None] = []
        for c in row.iter(MAIN + "c"):
            at = _column_number(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            cells[at] = self.value(c)
        return cells

    def rows(self) -> Iterator[list[str | None]]:
        with self.book.open(self.member) as stream:
            for _, row in ET.iterparse(stream):
                if row.tag == MAIN + "row":
                    yield self.cells(row)
                    row.clear()

    def raw_rows(self) -> Iterator[bytes]:
        """The bytes of each row element, without taking it apart; for sheets without a name space prefix."""
        with self.book.open(self.member) as stream:
            held = b""
            while more := stream.read(1 << 20):
                *whole, held = ROW_END.split(held + more)
                yield from whole

    def plain(self) -> bool:
        """Whether rows can be told by their bytes: the main name space has no prefix."""
        with self.book.open(self.member) as stream:
            return b"<sheetData" in stream.read(1 << 16)

    def taken_apart(self, raw: bytes) -> list[str | None]:
        at = raw.rfind(b"<row")
        element = raw[at:] + (b"" if raw.endswith(b"/>") else b"</row>")
        return self.cells(ET.fromstring(b'<s xmlns="' + MAIN[1:-1].encode() + b'" xmlns:r="urn:r" xmlns:x14ac="urn:x">' + element + b"</s>"))


#: What ends a row: its end tag, or that of a row without cells.
ROW_END = re.compile(rb"</row>|(?<=<row)(?=/>)")


def sheet_rows(book: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, by position or by name, as texts; empty cells are None."""
    yield from Sheet(book, sheet).rows()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _bytes(path: str) -> bytes:
    """The bytes of a workbook; those of file systems that only Spark opens come through :func:`read_workbooks`."""
    system, name = _opened(path)
    with system.open_input_file(name) as f:
        return f.read()


def _workbooks(paths: str) -> list[str]:
    """The workbooks of a list of paths and folders, in order of their names."""
    out = []
    for path in paths.split(","):
        system, name = _opened(path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            out.append(path)
            continue
        found = [f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.base_name.endswith((".xlsx", ".xlsm")) and not f.base_name.startswith(("_", "."))]
        out += [f"{path.rstrip('/')}/{n}" for n in sorted(found)]
    return out


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.names = options, schema.names
        self.width, self.size = len(self.names) - 1, int(options.get("rowsperpartition", "0"))
        self.tests: list[tuple[int, Filter]] = []

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in _workbooks(self.options["path"]):
            if not self.size:
                parts.append(_Part(path, 0, None))
                continue
            n = max(1, sum(1 for _ in Sheet(_bytes(path), _sheet(self.options)).raw_rows()) - 1)
            parts += [_Part(path, at, at + self.size) for at in range(0, n, self.size)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        sheet = Sheet(_bytes(partition.path), _sheet(self.options))
        if not sheet.plain():
            rows = ((i - 1, cells) for i, cells in enumerate(sheet.rows()) if i and partition.start <= i - 1 and (partition.end is None or i - 1 < partition.end))
        else:
            rows = self._ranged(sheet, partition)
        for i, cells in rows:
            cells = (cells + [None] * (self.width - len(cells)))[: self.width]
            if all(_holds(f, cells[at]) for at, f in self.tests):
                yield (*cells, i)

    def _ranged(self, sheet: Sheet, partition: _Part) -> Iterator[tuple[int, list[str | None]]]:
        looks = [(re.compile(rb'<c [^>]*\br="' + column_letters(at).encode() + rb'\d+"[^>]*?(?:/>|>.*?</c>)', re.S), f) for at, f in self.tests]
        for i, raw in enumerate(sheet.raw_rows()):
            if not i or i - 1 < partition.start:
                continue
            if partition.end is not None and i - 1 >= partition.end:
                return
            if b' r="' in raw[raw.rfind(b"<row") :] and not all(_holds(f, self._one(sheet, look, raw)) for look, f in looks):
                continue
            yield i - 1, sheet.taken_apart(raw)

    def _one(self, sheet: Sheet, look: re.Pattern, raw: bytes) -> str | None:
        m = look.search(raw)
        return (sheet.taken_apart(b"<row>" + m[0]) or [None])[-1] if m else None


class _PushingReader(_Reader):
    """Takes filters on text columns; ``_ord`` filters stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringContains, StringStartsWith, StringEndsWith)) and name in self.names[:-1]:
                self.tests.append((self.names.index(name), f))
            else:
                yield f


def _holds(f: Filter, v: str | None) -> bool:
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, In):
        return v is not None and v in f.value
    return v is not None and {EqualTo: lambda: v == f.value, IsNotNull: lambda: True, StringContains: lambda: f.value in v, StringStartsWith: lambda: v.startswith(f.value), StringEndsWith: lambda: v.endswith(f.value)}[type(f)]()


def _sheet(options: dict) -> str | int:
    """``options``: by lower-case name."""
    name = options.get("sheet", "0")
    return int(name) if name.isdigit() and options.get("sheetbyname", "false") != "true" else name


def _lower(options: dict) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}


class XlsxSource(DataSource):
    """``spark.read.format("xlsx")``: every column as text, and ``_ord``, the row's place (from 0) in its sheet; options ``sheet``,
    ``rowsPerPartition`` (default: a sheet is one) and ``pushdown`` (needs ``spark.sql.python.filterPushdown.enabled``).

    ``df.write.format("xlsx").mode(...).save(folder)``: a workbook for each partition, every value as text, nulls as empty cells; options
    ``sheet`` (the name) and ``styled``.  ``append`` adds workbooks, ``overwrite`` takes the place of those there once all are written."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        books = _workbooks(self.options["path"])
        if not books:
            raise FileNotFoundError(f"no workbook in {self.options['path']}")
        header = next(sheet_rows(_bytes(books[0]), _sheet(_lower(self.options))), [])
        return StructType([StructField(h or f"_c{i}", StringType()) for i, h in enumerate(header)] + [StructField("_ord", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown", "false") == "true" else _Reader)(_lower(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(_lower(self.options), schema, overwrite)


class _Written(WriterCommitMessage):
    def __init__(self, name: str) -> None:
        self.name = name


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.names, self.sheet, self.styled = schema.names, options.get("sheet", "Data"), options.get("styled", "true") == "true"
        self.hidden = f"{self.folder}/_temporary-{self.job}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.xlsx"
        system, hidden = _opened(self.hidden)
        system.create_dir(hidden, recursive=True)
        with tempfile.TemporaryFile() as held:  # a workbook has its widths before its rows
            write_book(held, self.names, iterator, self.sheet, self.styled)
            held.seek(0)
            with system.open_output_stream(f"{hidden}/{name}") as out:
                shutil.copyfileobj(held, out, 1 << 20)
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _opened(self.folder)
        system.create_dir(folder, recursive=True)
        before = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".xlsx")] if self.overwrite else []
        _, hidden = _opened(self.hidden)
        for m in messages:
            if m is not None:
                system.move(f"{hidden}/{m.name}", f"{folder}/{m.name}")
        for path in before:
            system.delete_file(path)
        self._cleared(system, hidden)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, hidden = _opened(self.hidden)
        self._cleared(system, hidden)

    def _cleared(self, system: fs.FileSystem, hidden: str) -> None:
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


def read_workbooks(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """What the data source reads, from any file system that Spark can open: a task a workbook, the columns of the first by path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no workbook at {path}")

    def heads(batches):
        for batch in batches:
            yield pd.DataFrame({"name": [h or f"_c{i}" for book in batch["content"] for i, h in enumerate(next(sheet_rows(bytes(book), sheet), []))]})

    names = [r["name"] for r in files.where(F.col("path") == first).mapInPandas(heads, "name string").collect()]

    def rows(batches):
        for batch in batches:
            for book in batch["content"]:
                cells = [(*row[: len(names)], *[None] * (len(names) - len(row)), i - 1) for i, row in enumerate(sheet_rows(bytes(book), sheet)) if i]
                yield pd.DataFrame(cells, columns=range(len(names) + 1))

    schema = StructType([*(StructField(n, StringType()) for n in names), StructField("_ord", LongType())])
    return files.repartition(F.col("path")).mapInPandas(rows, schema)


# --- writing ------------------------------------------------------------------------------

# Fixed values of the styled sheet: colours, fonts, borders, width limits.
STYLES = (
    '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<fonts count="5"><font><sz val="10"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font><font><b/><sz val="16"/><color rgb="FF1F4E78"/><name val="Calibri"/></font><font><i/><sz val="11"/><color rgb="FF595959"/><name val="Calibri"/></font><font><sz val="11"/><color rgb="FF000000"/><name val="Calibri"/></font></fonts>'
    '<fills count="6"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1F4E78"/></patternFill></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFC6EFCE"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFEB9C"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFC7CE"/></patternFill></fill></fills>'
    '<borders count="2"><border/><border><left style="thin"><color rgb="FFD9D9D9"/></left><right style="thin"><color rgb="FFD9D9D9"/></right><top style="thin"><color rgb="FFD9D9D9"/></top><bottom style="thin"><color rgb="FFD9D9D9"/></bottom></border></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="9"><xf/><xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>'
    '<xf fontId="0" borderId="1" applyBorder="1" applyAlignment="1"><alignment vertical="center"/></xf><xf fontId="2" applyFont="1"/><xf fontId="0" fillId="3" borderId="1" applyFill="1"/><xf fontId="0" fillId="4" borderId="1" applyFill="1"/><xf fontId="0" fillId="5" borderId="1" applyFill="1"/><xf fontId="3" applyFont="1"/><xf fontId="4" borderId="1" applyFont="1" applyBorder="1"/></cellXfs></styleSheet>'
)
HEADER, CELL, TITLE, GOOD, CHECK, BAD, SUBTITLE, BODY = 1, 2, 3, 4, 5, 6, 7, 8
LEAST_WIDTH, MOST_WIDTH, PAD = 12, 50, 3


def column_widths(df: DataFrame) -> DataFrame:
    """One row: each column's width, its longest text (the header's too) plus 3, between 12 and 50."""
    widest = lambda c: F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c)))
    return df.agg(*(F.least(F.greatest(widest(c) + PAD, F.lit(LEAST_WIDTH)), F.lit(MOST_WIDTH)).alias(c) for c in df.columns))


MOST_ROWS = 1_048_575


def _cell(r: int, c: int, v: object, style: int) -> str:
    return f'<c r="{column_letters(c)}{r}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(_clean(v))}</t></is></c>'


def _frame(z: zipfile.ZipFile, sheets: list[str]) -> None:
    """The parts of a workbook around its sheets."""
    number = [*range(1, len(sheets) + 1)]
    quoted = [escape(n, {chr(34): "&quot;"}) for n in sheets]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in number) + f'<Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
    z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(number, quoted, strict=True)) + "</sheets></workbook>")
    z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in number) + f'<Relationship Id="r{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
    z.writestr("xl/styles.xml", STYLES)


def _sheet_head(styled: bool, first: int, widths: list[int]) -> str:
    """Up to the rows: the frozen header in row ``first`` and the columns' widths."""
    out = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}">'
    if styled:
        out += f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{first}" topLeftCell="A{first + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        if widths:
            out += "<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1)) + "</cols>"
    return out + "<sheetData>"


def write_book(out, names: list[str], rows: Iterator, sheet: str = "Data", styled: bool = True, most_rows: int = MOST_ROWS) -> None:
    """A workbook of an iterator of rows, read once: rows beyond ``most_rows`` go on in further sheets (``sheet 2`` and so on)."""
    shown = [i for i, n in enumerate(names) if n != "_ord"]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        sheets: list[str] = []
        rows, more = iter(rows), True
        while more:
            widths, n = [len(names[i]) for i in shown], 0
            with tempfile.TemporaryFile() as held:  # the widths come first
                more = False
                for row in rows:
                    values = [row[i] for i in shown]
                    for c, v in enumerate(values):
                        widths[c] = max(widths[c], len(str(v)) if v is not None else 0)
                    held.write((f'<row r="{n + 2}">' + "".join(_cell(n + 2, c, v, CELL * styled) for c, v in enumerate(values) if v is not None) + "</row>").encode())
                    n += 1
                    if n == most_rows:
                        more = True
                        break
                if n == 0 and sheets:
                    break
                sheets.append(sheet if not sheets else f"{sheet} {len(sheets) + 1}")
                held.seek(0)
                with z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as into:
                    into.write(_sheet_head(styled, 1, [min(max(w + PAD, LEAST_WIDTH), MOST_WIDTH) for w in widths]).encode())
                    into.write(('<row r="1">' + "".join(_cell(1, c, names[i], HEADER * styled) for c, i in enumerate(shown)) + "</row>").encode())
                    shutil.copyfileobj(held, into, 1 << 20)
                    into.write(b"</sheetData></worksheet>")
        _frame(z, sheets)


def write_xlsx(df: DataFrame, path: str, sheet: str = "Data", styled: bool = True, above: list[str] | None = None, colours: dict[str, dict[str, int]] | None = None, most_rows: int = MOST_ROWS, labels: list[str] | None = None, body: int = CELL) -> None:
    """Write a result as one sheet of one local workbook, every value as text; rows come to the driver one partition at a time.

    ``above``: title, subtitle and more before the header. ``labels``: the header, if it is not the columns' names.
    ``colours``: column, value, style; ``body``: the style of other cells. A sheet holds ``most_rows``
    rows; larger results raise, as no sheet could hold them: ``df.write.format("xlsx")`` writes those, a workbook a partition.
    """
    names, above, colours = df.columns, above or [], colours or {}
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a sheet holds {most_rows} rows at most; write a folder of workbooks, CSV or Parquet instead")
    widths = list(column_widths(df).first()) if styled and names else []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        _frame(z, [sheet])
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            put = lambda s: out.write(s.encode())
            first = len(above) + 1
            put(_sheet_head(styled, first, widths))
            for r, line in enumerate(above, 1):
                put(f'<row r="{r}">' + (_cell(r, 0, line, {1: TITLE, 2: SUBTITLE}.get(r, 0)) if line else "") + "</row>")
            put(f'<row r="{first}">' + "".join(_cell(first, c, n, HEADER * styled) for c, n in enumerate(labels or names)) + "</row>")
            for r, row in enumerate(df.toLocalIterator(), first + 1):
                put(f'<row r="{r}">' + "".join(_cell(r, c, v, colours.get(names[c], {}).get(v, body * styled)) for c, v in enumerate(row) if v is not None) + "</row>")
            put("</sheetData></worksheet>")


# The sheet, its title and subtitle, and the columns with their labels.
BRAND_SHEET = "Brand Presence Audit"
BRAND_TITLE = "{country} Franchise Brand Existence & Misrepresentation Audit"
BRAND_SUBTITLE = "Dataset: {dataset} | Auditor: {auditor} | Total Brands: {brands} | Total Rows: {rows:,}"
BRAND_LABELS = {"brand_name": "Brand Name", "category": "Category", "branch_count": "Branch Count", "domain_hint": "Domain Hint (.{tld})", "status": "Status", "sample_website": "Sample Website", "reason": "Evidence / Issue Reason", "action_required": "Action Required"}


def write_brand_workbook(audit: DataFrame, path: str, country: str, auditor: str, dataset: str, total_rows: int | None = None) -> None:
    """The brand audit with title, subtitle with totals, the labelled header in row 4, and the status coloured.

    Columns that the audit lacks are left out; ``total_rows`` is the sum of its branches if it is not given.
    """
    status = {"Verified Present": GOOD, "Manual Review": CHECK, "Misrepresentation": BAD}
    names = [c for c in BRAND_LABELS if c in audit.columns]
    branches = F.sum("branch_count") if "branch_count" in names else F.lit(None)
    brands, rows = audit.agg(F.count("*"), branches).first()
    totals = BRAND_SUBTITLE.format(dataset=dataset, auditor=auditor, brands=brands, rows=total_rows if total_rows is not None else rows or 0)
    labels = [BRAND_LABELS[c].format(tld=country.lower()) for c in names]
    write_xlsx(audit.select(*names), path, BRAND_SHEET, above=[BRAND_TITLE.format(country=country), totals, ""], colours={"status": status}, labels=labels, body=BODY)


def _clean(v: object) -> str:
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
