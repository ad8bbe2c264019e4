import datetime

import pytest
from pyspark.sql import types as T

from tessera.catalog.quality import ANNOTATION
from tessera.sources import delimited as D

GOOD = "1ABC\tA\t2.10\tBS01\tATP\tB\tK1 L2\tfine\t2020-02-29"
FIELDS = GOOD.split("\t")


def line(**change):
    names = [f.name for f in ANNOTATION]
    return "\t".join(change.get(n, v) for n, v in zip(names, FIELDS))


VALID = [
    GOOD, GOOD + "\r", GOOD + "\r\n", line(pdb_id="pdb_0001fd3u"), line(pdb_id=" 1abc "), line(resolution=""), line(resolution="100"), line(resolution="  "), line(binding_site_id="BS123"), line(ccd_id="a"), line(receptor_chain="aB3d"),
    line(remark='"tab\tinside"'), line(remark='"line\nbreak"'), line(remark='"doubled "" quote"'), line(remark='""'), line(ccd_id='" ATP "'), line(site_residues=""), line(remark="x" * 300_000),
]
BROKEN = {
    "null_line": [None],
    "column_count": ["", "   ", "\t" * 7, GOOD + "\t", GOOD.replace("\t", ";"), GOOD.replace("\t", "  ")],
    "broken_quoting": [line(remark='"never closed'), line(remark='the "loose" one'), line(remark='ends with"'), line(remark='"closed" late'), line(remark=' "space before"'), line(remark='a"b')],
    "line_break_outside_quotes": [line(remark="a\nb"), line(remark="a\rb")],
    "invalid_pdb_id": [line(pdb_id="ABCD"), line(pdb_id="PDB_0001"), line(pdb_id="﻿1ABC"), line(pdb_id="1ABC "), line(pdb_id="1ABØ"), line(pdb_id="")],
    "invalid_resolution": [line(resolution=x) for x in ("0", "0.0", "100.1", "-1", "1e1", "inf", "nan", "2.", ".5", "2,1", "٢")],
    "invalid_binding_site_id": [line(binding_site_id=x) for x in ("BS1", "bs01", "BS1234", "BSXX")],
    "invalid_release_date": [line(release_date=x) for x in ("2021-02-29", "20200101", "2020-1-1", "", "0000-01-01", "2020-13-01")],
    "invalid_ligand_chain": [line(ligand_chain=x) for x in ("", "ABCDE", "A-B")],
}


def test_every_line_is_judged():
    for raw in VALID:
        reason, values = D.parse_record(raw, ANNOTATION)
        assert reason is None, (raw[:80], reason)
        assert values[0].isupper() and isinstance(values[8], datetime.date)
    for want, lines in BROKEN.items():
        for raw in lines:
            assert D.parse_record(raw, ANNOTATION) == (want, [None] * 9), raw


def test_rows_come_out_once_with_clashing_columns(spark):
    rows = [(i, "other", x) for i, x in enumerate([*VALID, *(x for xs in BROKEN.values() for x in xs), GOOD, GOOD])]
    out = D.parse_delimited(spark.createDataFrame(rows, "line_id bigint, ccd_id string, raw_line string"), "raw_line", ANNOTATION)
    assert out.columns == ["line_id", "in_ccd_id", "reject_reason", *(f.name for f in ANNOTATION)]
    got = {r.line_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert sum(r.reject_reason is None for r in got.values()) == len(VALID) + 2
    assert {r.reject_reason for r in got.values()} == {None, *BROKEN}
    assert D.accepted(out).count() + D.rejected(out).count() == len(rows)
    assert {r.reason: r.n_lines for r in D.reject_counts(out).collect()}["ok"] == len(VALID) + 2


def test_empty_table(spark):
    out = D.parse_delimited(spark.createDataFrame([], "line_id bigint, raw_line string"), "raw_line", ANNOTATION)
    assert out.count() == 0 and out.schema["resolution"].dataType == T.DoubleType()


def test_records_of_files(spark, tmp_path):
    records = [line(remark='"one\ntwo\nthree"'), GOOD, line(remark='"a\tb"')]
    (tmp_path / "a.tsv").write_text("\n".join(records) + "\n")
    (tmp_path / "b.tsv").write_text("")
    out = D.read_delimited(spark, str(tmp_path), ANNOTATION)
    assert sorted(r.remark for r in D.accepted(out).collect()) == ["a\tb", "fine", "one\ntwo\nthree"]
    assert D.rejected(out).count() == 0


@pytest.mark.parametrize("text", ['a\nb\n"c\nd"\n', '"x\n\n"\ny', ""])
def test_assemble_keeps_all_text(text):
    assert "".join(D.assemble(text.splitlines(keepends=True))) == text


STRAY = [line(remark='5" pipe'), line(remark='"never closed'), line(pdb_id='"1ABC'), line(remark='"closed" late'), line(ccd_id='AT"P'), line(release_date='"2020-02-29'), '"', 'x\t"']


@pytest.mark.parametrize("stray", STRAY)
def test_a_stray_quote_costs_its_own_line_only(stray):
    good = [line(remark=f"row {i}") for i in range(3)] + [line(remark='"two\nlines"')]
    text = "\n".join([good[0], stray, *good[1:]]) + "\n"
    records = list(D.assemble(text.splitlines(keepends=True), whole=lambda x: D.parse_record(x, ANNOTATION)[0] is None))
    assert "".join(records) == text
    read = [D.parse_record(r, ANNOTATION) for r in records]
    assert [v[7] for r, v in read if r is None] == ["row 0", "row 1", "row 2", "two\nlines"] and len(read) == 5


def test_good_lines_of_a_file_with_many_stray_quotes(spark, tmp_path):
    lines, good = [], []
    for i in range(400):
        lines.append(STRAY[i % len(STRAY)] if i % 3 == 0 else line(remark=f'"a\n{i}"' if i % 7 == 0 else str(i)))
        if i % 3:
            good.append(f"a\n{i}" if i % 7 == 0 else str(i))
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    out = D.read_delimited(spark, str(tmp_path), ANNOTATION)
    assert sorted(r.remark for r in D.accepted(out).collect()) == sorted(good)
