"""Workbooks: what is written is read back, whole or not at all."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gneiss.sources import workbook

ROWS = [(1, "a & b <c> \"q\"", 1.5, True, ["x", "y"]), (2, "line\nbreak\r\n\ttab", None, False, None), (3, None, -0.25, None, []), (4, " lead and trail ", 1e20, True, ["z"]), (5, "漢字 é \x01\x0c", float("nan"), None, [""])]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "id int, `text & more` string, number double, flag boolean, list array<string>")


def test_round_trip_of_sheets(spark, table, tmp_path):
    path = f"file://{tmp_path}/book.xlsx"
    big = spark.range(5000).select(F.col("id").alias("n"), F.concat(F.lit("t"), "id").alias("t")).repartition(7).orderBy("n")
    workbook.write({"First": table.orderBy("id"), "Large one": big, "Empty": table.limit(0)}, path, hidden=["Large one"])
    got = workbook.cells(spark, path)
    assert sorted({(r.place, r.sheet, r.hidden) for r in got.select("place", "sheet", "hidden").distinct().collect()}) == [(0, "First", False), (1, "Large one", True), (2, "Empty", False)]
    first = {r.row_no: r.cells for r in got.where("sheet = 'First'").collect()}
    assert first[1] == ["id", "text & more", "number", "flag", "list"]
    assert first[2] == ["1", ROWS[0][1], "1.5", "true", "x; y"] and first[3][:4] == ["2", "line\nbreak\r\n\ttab", None, "false"]
    assert first[4][1:4] == [None, "-0.25", None] and first[5][1] == " lead and trail " and float(first[5][2]) == 1e20 and first[6][1:3] == ["漢字 é ", None]
    large = {r.row_no: r.cells for r in got.where("sheet = 'Large one'").collect()}
    assert len(large) == 5001 and all(large[n + 2] == [str(n), f"t{n}"] for n in range(5000))
    assert workbook.sheet(spark, path, "Empty").columns == table.columns and workbook.sheet(spark, path, "Empty").isEmpty()
    assert sorted(int(r.n) for r in workbook.sheet(spark, path, "Large one").collect()) == list(range(5000))
    assert zipfile.ZipFile(tmp_path / "book.xlsx").testzip() is None and not list(tmp_path.glob("*.writing*"))


def test_shared_texts_and_places(spark, tmp_path):
    """A file of another writer: shared texts, cells by reference, rows left out."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "other.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="5"><c r="AB5"><v>3.5</v></c><c r="AC5" t="b"><v>0</v></c></row></sheetData></worksheet>')
    got = {r.row_no: r.cells for r in workbook.cells(spark, f"file://{tmp_path}/other.xlsx").collect()}
    assert got == {2: ["one", None, "two"], 5: [None] * 27 + ["3.5", "false"]}


def test_what_is_refused(spark, table, tmp_path):
    path = f"file://{tmp_path}/book.xlsx"
    workbook.write({"A": table}, path)
    with pytest.raises(ValueError):
        workbook.write({"A": table}, path)
    workbook.write({"B": table}, path, overwrite=True)
    assert {r.sheet for r in workbook.cells(spark, path).collect()} == {"B"}
    for bad in ({}, {"x" * 32: table}, {"a": table, "A": table}, {"a/b": table}):
        with pytest.raises(ValueError):
            workbook.write(bad, f"file://{tmp_path}/bad.xlsx")
    whole = (tmp_path / "book.xlsx").read_bytes()
    (tmp_path / "half.xlsx").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="not a whole workbook"):
        workbook.cells(spark, f"file://{tmp_path}/half.xlsx").collect()
    with pytest.raises(Exception):  # noqa: B017  the row can't be written
        workbook.write({"A": table.select(F.raise_error(F.lit("broken")).cast("string").alias("x"))}, f"file://{tmp_path}/lost.xlsx")
    assert not (tmp_path / "lost.xlsx").exists() and not list(tmp_path.glob("*.writing*"))


def test_views_and_order_of_sheets(spark):
    c = spark.createDataFrame([("n", "C", 3)], "`Compound Name` string, `Cluster ID` string, other int")
    made = workbook.assemble(c, {"Dashboard": c, "Clustering Policy": c}, "Own Structural Class")
    assert list(made) == ["Dashboard", "Summary", "Detailed Analysis", "Clustering Policy"]
    assert made["Summary"].columns == list(workbook.SUMMARY) and len(workbook.SUMMARY) == 24 and len(workbook.DETAILED) == 114 and len(set(workbook.DETAILED)) == 114
    assert "Own Structural Class" in made["Detailed Analysis"].columns and made["Summary"].first()["MW"] == "" and made["Summary"].first()["Cluster ID"] == "C"
    with pytest.raises(ValueError):
        workbook.assemble(c, {"Else": c})
