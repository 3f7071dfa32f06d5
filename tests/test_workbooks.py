"""Workbooks in and out, with every sheet and the hidden one."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from guidelens.operators import references, workbooks
from guidelens.sources import workbook


def test_cells_come_back(spark, tmp_path):
    odd = ["", "a<b>&\"c\"", " spaced  ", "é😀", "bell\x07 and _x0041_ and \x00", "line\nbreak\ttab", "x" * 32_767]
    rows = [(o, f"s{o}", o == 2, r, [{"text": t, "number": None} for t in odd[r % 7 :]] + [{"text": None, "number": r / 4}]) for o in (1, 2, 3) for r in range(1, 2500, 1 + o)]
    path = str(tmp_path / "w.xlsx")
    workbook.write(spark.createDataFrame(rows, workbook.SHEET_ROWS).repartition(7), path)
    assert zipfile.ZipFile(path).testzip() is None and not (tmp_path / "w.xlsx.draft").exists()
    got = {(r.file, r.ordinal, r.sheet, r.hidden, r.row): r.cells for r in workbook.read(spark, path).collect()}
    want = {("w.xlsx", o - 1, s, h, r): [c["text"] if c["number"] is None else repr(c["number"]) for c in cells] for o, s, h, r, cells in rows}
    assert got == want


def test_what_a_sheet_cannot_hold_is_an_error(spark, tmp_path):
    one = lambda name, row, text: spark.createDataFrame([(1, name, False, row, [{"text": text, "number": None}])], workbook.SHEET_ROWS)
    for bad in (one("a", 1, "x" * 32_768), one("a", workbook.MOST_ROWS + 1, "x"), one("a/b", 1, "x"), one("x" * 32, 1, "x")):
        with pytest.raises(Exception):
            workbook.write(bad, str(tmp_path / "bad.xlsx"))
        assert not (tmp_path / "bad.xlsx").exists()


def test_shared_strings_and_other_cells(spark, tmp_path):
    """What other programs write: shared strings with runs, booleans, formula texts, gaps, absolute targets."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="A" sheetId="7" r:id="q"/><sheet name="B" sheetId="9" state="veryHidden" r:id="p"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="p" Target="/xl/worksheets/two.xml"/><Relationship Id="q" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si></sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2" t="b"><v>1</v></c><c r="AA2"><v>7</v></c></row><row><c t="str"><v>f</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/two.xml", f"<worksheet {main}><sheetData/></worksheet>")
    got = [tuple(r) for r in workbook.read(spark, str(tmp_path / "o.xlsx")).orderBy("row").collect()]
    assert got == [("o.xlsx", 0, "A", False, 2, ["", "two runs", "", "TRUE", *[""] * 22, "7"]), ("o.xlsx", 0, "A", False, 3, ["f", "plain"])]


def sheet(ordinal, name, *rows):
    return [(ordinal, name, False, i + 1, [{"text": t, "number": None} for t in r]) for i, r in enumerate(rows)]


def test_reference_workbook(spark, tmp_path):
    """Columns by header in any order, by place where headers say nothing, and out and in again."""
    rows = sheet(1, "Default", ("Target Name", "gRNA-Sequence", "GENE name", "Gene Sequence"), ("t1", " ac gt", "g1", "aaa cc"), ("", "TT", "g1", "AAACC"), ("x", "", "g2", "GG"))
    rows += sheet(2, "BC 01", ("Homoeolog", "what", "is", "this", "?"), ("h", "g3", "ggg", "t", "c c"))
    rows += sheet(3, "stray", ("a", "b", "c", "d"), ("g4", "TTT", "", "AA"))
    path = str(tmp_path / "r.xlsx")
    workbook.write(spark.createDataFrame(rows, workbook.SHEET_ROWS), path)
    found = workbooks.reference_sheet_rows(workbook.read(spark, path))
    got = sorted(tuple(r)[1:] for r in found.collect())
    assert got == [("BC 01", 2, "g3", "h", "GGG", "t", "CC"), ("Default", 2, "g1", "", "AAACC", "t1", "ACGT"), ("Default", 3, "g1", "", "AAACC", "", "TT"), ("stray", 2, "g4", "", "TTT", "", "AA")]
    aliases = spark.createDataFrame([("bc_01.fastq", "other"), ("bc-01", "file-1")], "alias string, config_key string")
    roles = {r.sheet: r.config_key for r in workbooks.with_roles(found, aliases).collect()}
    assert roles == {"Default": "default", "BC 01": "file-1", "stray": None}
    (gene,) = references.genes_of(references.reference_payload(references.reference_rows(found.where("sheet = 'Default'"))))
    assert (gene.sequence, [t.guide for t in gene.targets]) == ("AAACC", ["ACGT", "TT"])
    again = found.select(F.when(F.col("sheet") == "Default", 1).when(F.col("sheet") == "BC 01", 2).otherwise(3).alias("at"), "sheet", "ordinal", "homoeolog_group", "gene", "sequence", "target_id", "guide")
    again = again.withColumnRenamed("ordinal", "position").withColumnRenamed("at", "ordinal")
    other = str(tmp_path / "again.xlsx")
    workbook.write(workbooks.reference_sheets(again), other)
    back = workbooks.reference_sheet_rows(workbook.read(spark, other))
    assert sorted((r.sheet, r.gene, r.sequence, r.target_id, r.guide) for r in back.collect()) == sorted((r.sheet, r.gene, r.sequence, r.target_id, r.guide) for r in found.collect())


def test_report(spark, tmp_path):
    """All sheets, and the whole report from the hidden one; a long report is in several pieces."""
    flow = spark.createDataFrame([("Merged", 30, 29, 28, 27), ("f/1", 10, 9, 8, 7)], "scope string, raw long, phred_passed long, usable long, assigned long")
    rows = [("f/1", f"gene {k:04d}", "Normal", "t1", 5, 4, 10.0, 20.5, 60.0, 9.5) for k in range(700)] + [("Merged", "g", "Rescued", "t", 1, 1, 0.0, 0.0, 100.0, 0.0)]
    targets = spark.createDataFrame(rows, "scope string, gene string, source string, target_id string, total_reads long, aligned_reads long, out_of_frame_pct double, in_frame_pct double, no_indel_pct double, substitution_pct double")
    params = {"Phred Threshold": 20.0, "DataType": "nanopore"}
    path = str(tmp_path / "report.xlsx")
    workbook.write(workbooks.report_sheets(params, flow, targets), path)
    cells = workbook.read(spark, path)
    sheets = cells.groupBy("sheet").agg(F.max("hidden").alias("hidden"), F.max("row").alias("rows")).collect()
    assert {r.sheet: r.hidden for r in sheets} == {"Merged": False, "f_1": False, ".metadata": True}
    shown = {r.row: r.cells for r in cells.where("sheet = 'f_1'").collect()}
    assert shown[2] == ["Phred Threshold", "20.0"] and shown[3] == ["DataType", "nanopore"] and shown[6] == ["Raw Reads", "10.0"]
    assert shown[13] == ["gene 0000", "Normal", "t1", "5.0", "4.0"] and shown[713 + 1][0] == "Gene" and shown[715] == ["gene 0000", "0.1", "0.205", "0.6", "0.095"] and max(shown) == 714 + 700
    report = {r.scope: json.loads(r.json) for r in workbooks.report_of(cells).collect()}
    assert report[""] == {"Phred Threshold": 20.0, "DataType": "nanopore"}
    assert report["Merged"]["readFlow"] == {"raw": 30, "phred_passed": 29, "usable": 28, "assigned": 27}
    assert [t["gene"] for t in report["f/1"]["targets"]] == [f"gene {k:04d}" for k in range(700)] and report["f/1"]["targets"][3]["in_frame_pct"] == 20.5
    assert cells.where("sheet = '.metadata'").count() > 3
