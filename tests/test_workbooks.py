from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkmill.sources import workbooks as W

MAIN, LINKS = W.MAIN, W.LINKS


def parsed(data: bytes) -> list:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(name, list(W._rows(z, part, []))) for name, part in W._sheets(z)]


def test_sheets_come_back(spark, tmp_path):
    questions = spark.createDataFrame([(1, "a\nb <&> \x01 _x0041_", None, True), (2, None, 2.5, False)], "n int, text string, x double, ok boolean").orderBy("n")
    answers = spark.createDataFrame([(10**16, "2")], "n long, label string")
    look = W.Sheet("questions", widths={"text": 55}, wrap=True, folded=("x",))
    W.write_workbook([(look, questions), (W.Sheet("answers", hidden=True), answers)], str(tmp_path / "book.xlsx"))
    rows, bad = W.read_workbooks(spark, str(tmp_path))
    assert bad.count() == 0
    got = sorted((r["sheet"], r["row"], r["cells"]) for r in rows.collect())
    assert got == [
        ("answers", 1, ["n", "label"]),
        ("answers", 2, ["10000000000000000", "2"]),
        ("questions", 1, ["n", "text", "x", "ok"]),
        ("questions", 2, ["1", "a\nb <&> \x01 _x0041_", None, "true"]),
        ("questions", 3, ["2", None, "2.5", "false"]),
    ]
    table = W.with_header(rows, "questions")
    assert table.columns == ["path", "n", "text", "x", "ok"] and sorted(r["n"] for r in table.collect()) == ["1", "2"]
    assert W.read_workbooks(spark, str(tmp_path), preview=1)[0].count() == 2
    with zipfile.ZipFile(tmp_path / "book.xlsx") as z:
        book, first = z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()
    assert book.count('state="hidden"') == 1 and 'state="frozen"' in first
    assert '<col min="2" max="2" width="55" customWidth="1"/>' in first and '<col min="3" max="3" width="12" customWidth="1" outlineLevel="1"/>' in first


def test_reports_are_never_cut(spark, tmp_path):
    with pytest.raises(ValueError, match="more than 3 rows"):
        W.write_workbook([(W.Sheet("s"), spark.range(4))], str(tmp_path / "x.xlsx"), most=3)
    with pytest.raises(ValueError, match="32767"):
        W.workbook([(W.Sheet("s"), ["a"], [["x" * 32_768]])])
    for names in (["a/b"], ["x" * 32], [""], ["a", "A"]):
        with pytest.raises(ValueError, match="name"):
            W.workbook([(W.Sheet(n), ["a"], []) for n in names])
    with pytest.raises(ValueError, match="visible"):
        W.workbook([(W.Sheet("a", hidden=True), ["a"], [])])


def test_other_writers_and_broken_files(spark, tmp_path):
    sheet = f'<worksheet xmlns="{MAIN}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2"><f>1+1</f><v>2</v></c></row><row><c t="str"><v>made</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>'
    strings = f'<sst xmlns="{MAIN}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r><rPh sb="0" eb="1"><t>hint</t></rPh></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="S" sheetId="1" r:id="x"/><sheet name="T" sheetId="2" r:id="y"/><sheet name="U" sheetId="3" r:id="z"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="/xl/worksheets/a.xml"/><Relationship Id="y" Target="worksheets/b.xml"/><Relationship Id="z" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", sheet)
        z.writestr("xl/worksheets/b.xml", "<worksheet><sheetData>")
        z.writestr("xl/sharedStrings.xml", strings)
    (tmp_path / "no.xlsx").write_bytes(b"not a workbook")
    rows, bad = W.read_workbooks(spark, str(tmp_path))
    assert sorted((r["sheet"], r["row"], r["cells"]) for r in rows.collect()) == [("S", 2, [None, "two", None, "2"]), ("S", 3, ["made", "one"])]
    assert sorted((r["path"].split("/")[-1], r["sheet"], r["problem"].split(":")[0]) for r in bad.collect()) == [("a.xlsx", "T", "ParseError"), ("a.xlsx", "U", "KeyError"), ("no.xlsx", None, "BadZipFile")]
    with pytest.raises(ValueError, match="no header"):
        W.with_header(rows, "S")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.none() | st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=20), min_size=1, max_size=30), max_size=5))
def test_any_text_comes_back(rows):
    width = max((len(r) for r in rows), default=1)
    whole = [[*r, *[None] * (width - len(r)), "end"] for r in rows]
    header = [f"c{i}" for i in range(width + 1)]
    assert parsed(W.workbook([(W.Sheet("s"), header, whole)])) == [("s", [(1, header), *((i, r) for i, r in enumerate(whole, 2))])]


def test_column_names():
    assert [W.letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
