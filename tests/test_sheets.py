"""Sheets are written and read back, and say what is wrong with them."""

import io
import random
import zipfile

import pytest

from scorewright.plans.registry import QUERIES
from scorewright.sources import readers, sheets


def test_values_survive(spark):
    rows = [(1, "a <b> & \"c\"", None), (2, " spaced  ", 2.5), (3, "", -7), (4, None, None), (5, "line\nend é \x07", True)]
    content = sheets.sheet_bytes(["k", "text", "n"], rows)
    files = spark.createDataFrame([("good", content), ("none", b"no zip"), ("null", None)], "path string, content binary")
    got = {(r["path"], r["k"]): (r["text"], r["n"], r["error"]) for r in sheets.sheet_rows(files, ["n", "k", "text"]).collect()}
    assert got == {("good", "1"): ('a <b> & "c"', "", None), ("good", "2"): (" spaced  ", "2.5", None), ("good", "3"): ("", "-7", None), ("good", "4"): ("", "", None), ("good", "5"): ("line\nend é  ", "True", None), ("none", None): (None, None, "unreadable_xlsx")}
    wrong = {r["path"]: (r["row_ord"], r["error"]) for r in sheets.sheet_rows(files, ["k", "gone", "too"]).collect()}
    assert wrong == {"good": (-1, "missing_columns:gone,too"), "none": (-1, "unreadable_xlsx")}
    assert readers.office_text(content, "xlsx")[0].split("\n")[0] == "k\ttext\tn"


def test_cells_that_are_left_out_and_shared_strings(spark):
    body = '<worksheet xmlns="{0}"><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row/><row><c r="C3"><v>5</v></c></row><row><c r="A4"><v> </v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets._MAIN}"><si><t>last</t></si><si><r><t>fi</t></r><r><t>rst</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", body.format(sheets._MAIN))
    files = spark.createDataFrame([("a", out.getvalue()), ("b", sheets.sheet_bytes([], [])[:40])], "path string, content binary")
    rows = {(r["path"], r["row_ord"], r["first"], r["last"], r["error"]) for r in sheets.sheet_rows(files, ["first", "last"]).collect()}
    assert rows == {("a", 1, "", "5", None), ("b", -1, None, None, "unreadable_xlsx")}


def test_a_sheet_has_no_more_rows_than_fit(monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        sheets.sheet_bytes(["a"], [(1,), (2,), (3,)])


def test_seeded_sample_repeats_the_draw(spark, tmp_path):
    rows = [(i * 3, f"s{i % 4}", "x" * (i * 7 % 30)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["pick"] for r in QUERIES["seeded_sample"](spark, str(tmp_path)).collect()}
    drawn = {rows[p][0] for p in random.Random(42).sample(range(60), 20)}
    longest = {max((r for r in rows if r[1] == s), key=lambda r: (len(r[2]), -r[0]))[0] for s in ("s0", "s1", "s2", "s3")}
    assert got == {i: "longest" for i in longest - drawn} | {i: "random" for i in drawn}
