"""Excel workbooks as tables of text, read by the tasks that hold them, alone or as members of zips.

A workbook is a zip of XML parts: sheets name their cells (A1), strings stand in a shared list. Sheets are parsed as a stream,
so a task holds the workbook and its shared strings, not its rows. All cells are text as stored; blank ones are null.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.columns import zpad
from gridfold.sources.readers import SourceMissing

#: Rows of a sheet that a task hands on at once.
ROWS = 5_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(reference: str) -> int:
    """The column number of a cell's name, from 0: A1 is 0, AA7 is 26."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node) -> str:
    """A string's text: its own or that of its runs, without phonetic notes."""
    return "".join(t.text or "" for child in node for t in ([child] if _local(child.tag) == "t" else [x for x in child if _local(x.tag) == "t"] if _local(child.tag) == "r" else []))


def _sheet_part(book: zipfile.ZipFile, sheet: int | str) -> str:
    """The part that holds a sheet, by its place or name in the workbook."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    names = [(n.get("name"), next(v for k, v in n.attrib.items() if _local(k) == "id" and "}" in k)) for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"]
    found = [i for k, (name, i) in enumerate(names) if sheet in (k, name)]
    if not found:
        raise SourceMissing(f"no sheet {sheet!r} in {[n for n, _ in names]}")
    target = targets[found[0]]
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def cells_of(content: bytes, sheet: int | str = 0, last: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """Row number (from 0) and cells of a sheet's rows, up to row `last`; rows that the sheet leaves out are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, node in ElementTree.iterparse(part):
                    if _local(node.tag) == "si":
                        shared.append(_text(node))
                        node.clear()
        with book.open(_sheet_part(book, sheet)) as part:
            at = -1
            for _, node in ElementTree.iterparse(part):
                if _local(node.tag) != "row":
                    continue
                at = int(node.get("r")) - 1 if node.get("r") else at + 1
                if last is not None and at > last:
                    return
                row: list[str | None] = []
                for cell in node:
                    k = _column(cell.get("r")) if cell.get("r") else len(row)
                    value = next((c.text for c in cell if _local(c.tag) == "v"), None)
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = next((_text(c) for c in cell if _local(c.tag) == "is"), None)
                    row.extend([None] * (k + 1 - len(row)))
                    row[k] = value if value else None
                yield at, row
                node.clear()


def sheet_rows(files: DataFrame, sheet: int | str = 0, member: str = "", last: int | None = None) -> DataFrame:
    """path, row_no, cells of workbooks. files: path, content; with `member`, zips whose members' names end so (any case) are the workbooks."""

    def run(batches: Iterable) -> Iterable:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                books = [content]
                if member:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        books = [z.read(n) for n in sorted(z.namelist()) if n.lower().endswith(member.lower())]
                    if not books:
                        raise SourceMissing(f"{path}: no member like {member!r}")
                rows = []
                for book in books:
                    for at, cells in cells_of(book, sheet, last):
                        rows.append((path, at, cells))
                        if len(rows) == ROWS:
                            yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, row_no long, cells array<string>")


def table(files: DataFrame, header: int = 0, sheet: int | str = 0, member: str = "") -> DataFrame:
    """A sheet as a table of text columns named by its header row (from 0); what stands above goes. Only the header's rows are parsed for the names."""
    head = sheet_rows(files, sheet, member, header).filter(F.col("row_no") == header).select("cells").first()
    if head is None:
        raise SourceMissing(f"no row {header} in the sheet")
    rows = sheet_rows(files, sheet, member).filter(F.col("row_no") > header)
    return rows.select(*[F.trim(F.get("cells", F.lit(k))).alias(name.strip()) for k, name in enumerate(head.cells) if name and name.strip()])


def excel(spark: SparkSession, path: str, header: int = 0, sheet: int | str = 0, member: str = "") -> DataFrame:
    """Workbooks (or zips of them) at a path that Spark reads."""
    return table(spark.read.format("binaryFile").load(path).select("path", "content"), header, sheet, member)


def metro_counties(df: DataFrame) -> DataFrame:
    """A delineation of metros: county code, names, metro code, kind of area, whether it is a metro. Footnotes (no codes) go."""
    # fixed values: the published sheet's column names
    names = {"CBSA Code": "cbsa_code", "CBSA Title": "cbsa_title", "CSA Title": "csa_title", "Metropolitan/Micropolitan Statistical Area": "area_type", "FIPS State Code": "state_fips", "FIPS County Code": "county_fips", "County/County Equivalent": "county_name", "Central/Outlying County": "county_role"}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).dropna(subset=["cbsa_code", "state_fips", "county_fips"])
    return rows.select(F.concat(zpad("state_fips", 2), zpad("county_fips", 3)).alias("county_geoid"), "county_name", "cbsa_code", "cbsa_title", "csa_title", "area_type", F.coalesce(F.col("area_type").startswith("Metro"), F.lit(False)).alias("is_metro"), "county_role")


def workbook(rows: Sequence[Sequence], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet: numbers as numbers, other values as shared strings, None as no cell. For small tables, on the driver."""
    shared: dict[str, int] = {}
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for k, v in enumerate(row):
            letters, n = "", k + 1
            while n:
                n, rest = divmod(n - 1, 26)
                letters = chr(65 + rest) + letters
            if v is None:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{letters}{r}"><v>{v}</v></c>')
            else:
                cells.append(f'<c r="{letters}{r}" t="s"><v>{shared.setdefault(str(v), len(shared))}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{kind}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{"".join(f"<si><t xml:space=\"preserve\">{escape(s)}</t></si>" for s in shared)}</sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in parts.items():
            z.writestr(part, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
    return out.getvalue()
