"""The parallel CSV scan against a one-pass parser."""

import random

import pytest

from quernstone.sources import csvscan, records


def plain(text):
    """The rule, a character at a time."""
    out, record, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"' and quoted and text[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            record, cell = [*record, cell], ""
        elif c == "\n" and not quoted:
            out.append([*record, cell.rstrip("\r")])
            record, cell = [], ""
        else:
            cell += c
        i += 1
    if cell or record:
        out.append([*record, cell.rstrip("\r")])
    return None if quoted else out


def test_quotes_count_wherever_they_stand():
    assert csvscan.cells_of('a"b,c"d,e\n') == [["ab,cd", "e"]]
    assert csvscan.cells_of(' x , "q,r"') == [[" x ", " q,r"]]
    assert csvscan.cells_of('"a""b",""""\r\n') == [['a"b', '"']]
    assert records.csv_records('n,m\n"1\n2",3\n\n,\n4\n') == [{"n": "1\n2", "m": "3"}, {"n": "4", "m": ""}]
    with pytest.raises(records.SourceError):
        records.csv_records('a\n"b\n')


def test_cells_of_random_texts():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice('ab,"\n\r é') for _ in range(rng.randrange(30)))
        want = plain(text)
        if want is None:
            with pytest.raises(ValueError):
                csvscan.cells_of(text)
        else:
            assert csvscan.cells_of(text) == want


def test_scan_of_split_files_like_one_pass(spark, tmp_path):
    rng = random.Random(5)
    made = {}
    for k in range(4):
        lines = ['name, n ,name,"long\ntext"'] if k else ["﻿name,n"]
        for i in range(300):
            cells = []
            for _ in range(rng.randrange(1, 5)):
                cell = "".join(rng.choice("abc é") for _ in range(rng.randrange(9)))
                roll = rng.random()
                cells.append(f'"{cell},\n""{cell}\n"' if roll < 0.2 else f'{cell}"x,y"{cell}' if roll < 0.3 else cell)
            lines.append(",".join(cells) if rng.random() > 0.05 else "")
        if k == 3:
            lines.append('"' + "very long\n" * 2000 + '",end')
        made[f"f{k}.csv"] = ("\r\n" if k == 2 else "\n").join(lines) + ("\n" if k % 2 else "")
        (tmp_path / f"f{k}.csv").write_text(made[f"f{k}.csv"], newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = csvscan.csv_rows(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in made.items():
        got = [r.record for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.row_index)]
        assert got == records.csv_records(text), name
        assert sorted(r.row_index for r in rows if r.path.endswith(name)) == list(range(1, len(got) + 1))


def test_open_quotes_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert csvscan.csv_rows(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.csv").write_text('a\n"b\n')
    with pytest.raises(ValueError):
        csvscan.csv_rows(spark, str(tmp_path))
