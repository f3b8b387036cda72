"""Records put together from splits against Spark's reading of the whole file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from snapledger.sources import records
from snapledger.sources.csv import _read_group, count_records, read_csv_rows, read_csv_text
from snapledger.sources.records import BrokenRecord, line_effect

PIECES = ["", "a", "two\nlines", 'say "hi"', "x,y", "\n\n", '"', "tail \r\n end", "plain", 'q"\n"', "ü\né"]


def write(path, seed, rows, end="\n"):
    rnd = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(["id", "t", "u"])
        for i in range(rows):
            writer.writerow([i, rnd.choice(PIECES) + "x" * rnd.randrange(60), rnd.choice(PIECES)])


@pytest.fixture
def small_splits(spark):
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes",
                                                   "spark.sql.files.openCostInBytes")}
    # Splits of a few records, down to splits in which no record starts.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_as_reading_whole(spark, tmp_path, small_splits, end):
    write(tmp_path / "a.csv", 1, 150, end)
    write(tmp_path / "b.csv", 2, 40, end)
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    with open(paths[0], newline="", encoding="utf-8") as file:
        truth = [(r[0], r[1] or None, r[2] or None) for r in csv.reader(file)][1:]
    found = read_csv_text(spark, paths[:1])
    assert sorted(map(tuple, found.collect()), key=lambda r: int(r[0])) == truth
    if end == "\n":
        # Spark's own reading turns \r\n inside values into \n where lines end that way.
        both = sorted(map(tuple, read_csv_text(spark, paths, keep_path=True).collect()), key=repr)
        whole = sorted(map(tuple, _read_group(spark, paths, ["id", "t", "u"], "drop", True).drop("__corrupt").collect()), key=repr)
        assert both == whole and len(both) == 190


def test_long_value_over_many_splits(spark, tmp_path, small_splits):
    value = "\n".join(f"line {i}, with \"\"quotes\"\"" for i in range(200))
    (tmp_path / "long.csv").write_text(f'id,t\n1,"{value}"\n2,b\n')
    rows = {r["id"]: r["t"] for r in read_csv_text(spark, [str(tmp_path / "long.csv")]).collect()}
    assert rows == {"1": value.replace('""', '"'), "2": "b"}


def test_malformed_records(spark, tmp_path, small_splits):
    (tmp_path / "m.csv").write_text('id,t\n1,"a\nb"\n2\n3,c,z\n\n4,d\n')
    path = [str(tmp_path / "m.csv")]
    rows = {(r["id"], r["t"]) for r in read_csv_text(spark, path).collect()}
    assert rows == {("1", "a\nb"), ("4", "d")} == {
        (r["id"], r["t"]) for r in _read_group(spark, path, ["id", "t"], "drop", True).collect() if r["__corrupt"] is None}
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv_text(spark, path, "fail").collect()


def test_stray_quotes_are_read_as_in_sequence(spark, tmp_path, small_splits):
    (tmp_path / "s.csv").write_text('id,t\n1,5" pipe\n2,"x\ny"\n3,6" pipe\n4,z\n')
    (tmp_path / "sound.csv").write_text('id,t\n7,"p\nq"\n')
    path = [str(tmp_path / "s.csv"), str(tmp_path / "sound.csv")]
    rows = {(r["id"], r["t"]) for r in read_csv_text(spark, path).collect()}
    assert rows == {(r["id"], r["t"]) for r in _read_group(spark, path, ["id", "t"], "drop", True).collect()}
    assert {("4", "z"), ("7", "p\nq")} <= rows


def machine(line, inside):
    """What a line does to being inside a value, character by character; and whether a carried value ends uncleanly."""
    line = line.removesuffix("\r")
    carried, unclean, field, i = inside, False, not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"' and line[i + 1:i + 2] == '"':
                i += 1
            elif c == '"':
                unclean = unclean or (carried and line[i + 1:].split(",")[0] != "")
                inside = carried = field = False
                # What follows up to the next comma belongs to the field.
                i += len(line[i + 1:].split(",")[0])
        elif c == '"' and field:
            inside, field = True, False
        else:
            field = c == ","
        i += 1
    return inside, unclean


def test_effect_of_a_line_character_by_character(spark):
    rnd = random.Random(3)
    lines = ["".join(rnd.choice(['"', '"', ",", "a", "b ", "\r"]) for _ in range(rnd.randrange(9))) for _ in range(4000)]
    lines += ['5" pipe', 'a,5"', '"a"b,c', 'x"a",c', '"open', '"a,b', 'a",b', '""",', '"a""', "", '"', '""']
    found = spark.createDataFrame([(t,) for t in lines], "t string").select("t", line_effect(F.col("t")).alias("e")).collect()
    for row in found:
        out, inside = machine(row["t"], False), machine(row["t"], True)
        assert (row["e"]["opens"], row["e"]["keeps"]) == (out[0], inside[0]), row
        assert row["e"]["unclean"] == inside[1], row


@pytest.mark.parametrize(("at", "how"), [(2, "ends before other text"), (1999, "is open when the file ends")])
def test_one_odd_quote_in_a_dump_of_many_splits_is_named(spark, tmp_path, small_splits, at, how):
    lines = [f'{i},"a, b",x{i}' for i in range(1, 2000)]
    lines[at - 1] = f'{at},"a,x'
    (tmp_path / "o.csv").write_text("id,t,u\n" + "\n".join(lines) + "\n")
    for mode in ("drop", "fail"):
        with pytest.raises(BrokenRecord, match=f"o.csv line {at + 1}: .* {how}"):
            read_csv_rows(spark, [str(tmp_path / "o.csv")], mode)


def test_a_record_beyond_the_bound_is_named(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "MAX_RECORD_BYTES", 5000)
    (tmp_path / "l.csv").write_text('id,t\n1,a\n2,"b\n' + "plain line\n" * 900 + 'end"\n3,c\n')
    with pytest.raises(BrokenRecord, match="l.csv line 3: .* is too long"):
        read_csv_rows(spark, [str(tmp_path / "l.csv")])


def test_a_stray_quote_in_a_bare_value_is_text(spark, tmp_path, small_splits):
    lines = [f'{i},5" pipe' if i % 7 == 0 else f'{i},"two\nlines"' if i % 5 == 0 else f"{i},v" for i in range(1, 800)]
    (tmp_path / "s.csv").write_text("id,t\n" + "\n".join(lines) + "\n")
    rows = {r["id"]: r["t"] for r in read_csv_text(spark, [str(tmp_path / "s.csv")]).collect()}
    assert rows == {str(i): '5" pipe' if i % 7 == 0 else "two\nlines" if i % 5 == 0 else "v" for i in range(1, 800)}


def test_malformed_rows_are_told_and_counted(spark, tmp_path, small_splits):
    (tmp_path / "m.csv").write_text('id,t\n1,"a\nb"\n2\n3,c,z\n\n4,d\n')
    (tmp_path / "p.csv").write_text("id,t\n5,x\n6\n\n7,y,z\n")
    paths = [str(tmp_path / "m.csv"), str(tmp_path / "p.csv")]
    rows = read_csv_rows(spark, paths).collect()
    assert sorted(r["__corrupt"] for r in rows if r["__corrupt"]) == ["2", "3,c,z", "6", "7,y,z"]
    counted = {r["path"].rpartition("/")[2]: r["n_records"] for r in count_records(spark, paths).collect()}
    assert counted == {"m.csv": 4, "p.csv": 3}


def test_blank_lines_before_the_header(spark, tmp_path, small_splits):
    (tmp_path / "b.csv").write_text('\n\nid,t\n1,"a\nb"\n')
    assert [tuple(r) for r in read_csv_text(spark, [str(tmp_path / "b.csv")]).collect()] == [("1", "a\nb")]
