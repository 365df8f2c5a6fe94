"""Spreadsheets, generated part by part."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from panelweave.sources.readers import read_table
from panelweave.sources.sheets import read_sheet, sheet_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets):
    """sheets: name -> rows of raw cell XML by reference, e.g. {"A1": 's:Name', "B2": "n:5"}."""
    strings = []

    def cell(ref, spec):
        kind, _, value = spec.partition(":")
        if kind == "s":
            if value not in strings:
                strings.append(value)
            return f'<c r="{ref}" t="s"><v>{strings.index(value)}</v></c>'
        if kind == "i":
            return f'<c r="{ref}" t="inlineStr"><is><r><t>{escape(value[:1])}</t></r><r><t>{escape(value[1:])}</t></r></is></c>'
        return f'<c r="{ref}"' + ("" if kind == "n" else f' t="{kind}"') + (f"><v>{escape(value)}</v></c>" if value else "/>")

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = links = ""
        for i, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(ref, spec) for ref, spec in cells) + "</row>" for n, cells in rows)
            target = f"worksheets/sheet{i}.xml" if i % 2 else f"/xl/worksheets/sheet{i}.xml"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>')
            listed += f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>'
            links += f'<Relationship Id="rId{i}" Target="{target}"/>'
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{escape(s)}</t><rPh><t>x</t></rPh></si>" for s in strings) + "</sst>")


@pytest.fixture()
def states(tmp_path):
    rows = [
        (1, [("A1", "s:Union density")]),
        (3, [("A3", "s:State Name"), ("B3", "i:%Mem64"), ("D3", "s:Code")]),
        (4, [("A4", "s:Ohio & more"), ("B4", "n:37.5"), ("C4", "n:1"), ("D4", "s:01")]),
        (6, [("A6", "i:Iowa"), ("C6", "n:2"), ("D6", "n:2"), ("AA6", "n:9")]),
        (7, [("A7", "str:Utah"), ("B7", "e:#N/A"), ("C7", "b:1"), ("D7", "n:")]),
    ]
    workbook(tmp_path / "a b.xlsx", {"Notes": [(1, [("A1", "s:nothing")])], "Data": rows})
    return tmp_path / "a b.xlsx"


def test_rows_with_types_and_gaps(states):
    got = list(sheet_rows(states.read_bytes(), "Data"))
    assert [n for n, *_ in got] == [1, 3, 4, 6, 7]
    assert got[2][1:] == (["Ohio & more", "37.5", "1", "01"], [False, True, True, False])
    assert got[3][1][:4] == ["Iowa", None, "2", "2"] and got[3][1][26] == "9" and got[3][2][1] is None
    assert got[4][1:] == (["Utah", None, "TRUE"], [False, None, False])
    assert list(sheet_rows(states.read_bytes(), 0)) == [(1, ["nothing"], [False])]
    with pytest.raises(ValueError):
        list(sheet_rows(states.read_bytes(), "None"))


def test_frame(spark, states):
    got = read_sheet(spark, str(states), "Data", skip=1, source="file")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("State Name", "string"), ("%Mem64", "double"), ("X3", "string"), ("Code", "string"), ("file", "string")]
    rows = sorted(tuple(r)[:4] for r in got.collect())
    assert rows == [("Iowa", None, "2", "2"), ("Ohio & more", 37.5, "1", "01"), ("Utah", None, "TRUE", None)]
    assert read_table(spark, str(states)).columns == ["nothing"]
    as_text = read_sheet(spark, str(states), "Data", skip=1, text=["%Mem64"])
    assert as_text.schema["%Mem64"].dataType.simpleString() == "string"


def test_many_files(spark, tmp_path):
    for i in range(30):
        head = (1, [("A1", "s:k"), ("B1", "s:v")])
        workbook(tmp_path / f"f{i}.xlsx", {"S": [head, *[(r + 2, [(f"A{r + 2}", f"s:k{r}"), (f"B{r + 2}", f"n:{i * 1000 + r}")]) for r in range(i * 10)]]})
    got = read_sheet(spark, f"{tmp_path}/*.xlsx")
    total = sum(i * 1000 + r for i in range(30) for r in range(i * 10))
    assert got.count() == sum(i * 10 for i in range(30)) and got.selectExpr("sum(v)").first()[0] == total
    workbook(tmp_path / "other.xlsx", {"S": [(1, [("A1", "s:other")])]})
    with pytest.raises(ValueError, match="differ"):
        read_sheet(spark, f"{tmp_path}/*.xlsx")
