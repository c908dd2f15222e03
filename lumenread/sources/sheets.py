"""Office Open XML workbooks and archives, with the standard library only."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Names of the format: fixed values.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Sheet, row, column and value of every filled cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            tree = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            for cell in tree.iter(f"{MAIN}c"):
                place = re.fullmatch(r"([A-Z]+)([0-9]+)", cell.get("r"))
                value = cell.find(f"{MAIN}v")
                kind = cell.get("t")
                text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if kind == "inlineStr" else None if value is None else strings[int(value.text)] if kind == "s" else value.text
                if text is not None:
                    yield sheet.get("name"), int(place[2]), column_number(place[1]), text


def workbook(sheets: dict[str, Sequence[Sequence]]) -> bytes:
    """A workbook of named sheets, each a list of rows; numbers stay numbers and None is an empty cell."""

    def cell(row: int, column: int, value: object) -> str:
        at = f"{column_letters(column)}{row}"
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    out = io.BytesIO()
    main, office = MAIN[1:-1], RELATION[1:-3]
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        related = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{related}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and content of the files in a zip or tar archive, compressed or not."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                if not name.endswith("/"):
                    yield name, archive.read(name)
        return
    with tarfile.open(fileobj=io.BytesIO(content)) as archive:
        for member in archive:
            if member.isfile():
                yield member.name, archive.extractfile(member).read()
