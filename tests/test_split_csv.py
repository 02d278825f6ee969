"""Large CSV files with line breaks in quoted cells, read block by block."""

from __future__ import annotations

import csv as plain
import io
import random

import pytest

from sievework.sources import csv, records


def cells(rng):
    return rng.choice(["", "a", "5\" pipe", "x, y", "two\nlines", "\n\n", "say \"hi\"", "\"", "'", "é\n\"q\",\n", "long " * 30, "\r\nwin", ",", " "])


def test_lines_end_inside():
    for line, outside, inside in [("a,b", False, True), ('a,"b', True, False), ('"a""b",c', False, False), ('5" pipe,x', False, False),
                                  ('"a"b"c,d', False, False), ('x",y', False, False), ('x","y', True, True), ('""', False, True), ('a,""', False, True),
                                  ('"""', True, False), ("", False, True), ('x"",y', False, True)]:
        assert records.ends_inside(line, False) is outside, line
    for line, after in [("a", True), ('a"', False), ('a""', True), ('a"",b"', False), ('a","b', True), ('a",b', False), ('a"x"y,c', False)]:
        assert records.ends_inside(line, True) is after, line


def test_many_lines_end_where_single_ones_do():
    """Lines taken as one text give what they give one by one, however they are cut into batches."""
    rng, seen = random.Random(3), set()
    for _ in range(3000):
        lines = ["".join(rng.choices('",a\r', k=rng.randrange(6))) for _ in range(rng.randrange(1, 5))]
        for inside in (False, True):
            state = inside
            for line in lines:
                state = records.ends_inside(line, state)
            assert records.text_ends_inside("".join(f"{line}\n" for line in lines), inside) is state, lines
            seen.add((inside, state))
    assert len(seen) == 4


def test_lines_are_cut_once(spark, tmp_path, monkeypatch):
    """The second pass over the lines is written, so that whole records and pieces do not each run it."""
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n')
    written = []
    monkeypatch.setattr(records, "materialize", lambda df, label: written.append(label) or df)
    assert csv.read_text_table(spark, str(tmp_path / "a.csv"), split=True).collect()[0].y == "a\nb"
    assert written == ["csv-records"]


@pytest.mark.parametrize("block", [64, 300, 5000])
def test_rows_do_not_depend_on_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    rows = [[f"id{k}"] + [cells(rng) for _ in range(3)] for k in range(400)]
    for part in (0, 1):
        text = io.StringIO()
        out = plain.writer(text, lineterminator="\n", quoting=plain.QUOTE_ALL if part else plain.QUOTE_MINIMAL)
        out.writerow(["id", "b c", "line\nbreak", "d`e"])
        out.writerows(rows[part::2])
        (tmp_path / f"f{part}.csv").write_bytes(("\n" * part + text.getvalue()).encode())
    (tmp_path / "empty.csv").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        paths = [str(tmp_path / f"f{k}.csv") for k in (0, 1)]
        df = csv.read_text_table(spark, *paths, split=True)
        want = csv._reader(spark).csv(paths)
        assert df.columns == want.columns == ["id", "b c", "line\nbreak", "d`e"]
        got = sorted(map(tuple, csv._split_table(spark, *paths).collect()), key=str)
        assert got == sorted(map(tuple, want.collect()), key=str) and len(got) == 400
        assert spark.read.text(paths).rdd.getNumPartitions() > 8 or block == 5000
        assert df.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_other_headers_stop(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(Exception, match="headers"):
        csv.read_text_table(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), split=True).collect()
