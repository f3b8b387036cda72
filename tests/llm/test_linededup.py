import random
import re
from collections import defaultdict

import pytest

from snapledger.llm import linededup
from tests.llm.odd import ROWS, frame


def brute(rows, least):
    """Numbers of the lines to remove: all runs of at least so many words that occur earlier."""
    docs = [[(i, x) for i, x in enumerate((text or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)] for _, text in rows]
    places, gone = defaultdict(list), [set() for _ in rows]
    for d, lines in enumerate(docs):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for _, x in lines[i:j]) >= least:
                    places[tuple(x for _, x in lines[i:j])].append((d, i, j))
    for found in places.values():
        for d, i, j in found[1:]:
            gone[d].update(n for n, _ in docs[d][i:j])
    for lines, out in zip(docs, gone, strict=True):  # empty lines between removed ones
        for (n, _), (m, _) in zip(lines, lines[1:]):
            if n in out and m in out:
                out.update(range(n, m))
    return gone


def removed(text):
    return {n for part in text.split(",") if part for n in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 4), (3, 9), (4, 30)])
def test_against_all_runs(spark, seed, least):
    rng = random.Random(seed)
    lines = [" ".join(["w"] * rng.randint(1, 4)) + f" {i}" for i in range(6)]
    rows = [(i, "\n".join(rng.choice([*lines, "", f"own {i}-{rng.random()}"]) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], removed(r["removed"])) for r in linededup.dedup_lines(df, "doc_id", "text", min_words=least).collect()}
    for (key, text), gone in zip(rows, brute(rows, least), strict=True):
        assert got[key] == ("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), gone)


def test_long_run_over_many_lines(spark):
    shared = "\n".join(f"line {i}" for i in range(300))
    rows = [(1, f"a\n{shared}\nb"), (2, f"{shared}\nc"), (3, "line 5\nline 6")]
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: "", 2: "0-299", 3: ""}


def test_repeated_rows_and_very_long_texts(spark):
    shared = "\n".join(f"row {i} of the shared part" for i in range(5_000))
    rows = [(1, shared)] * 40 + [(2, f"own words\n{shared}\n{'x' * 200_000}")] * 40 + [(None, "row 1 of the shared part")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.dedup_lines(df, "doc_id", "text").groupBy("doc_id", "removed").count().collect()
    assert {(r["doc_id"], r["removed"], r["count"]) for r in got} == {(1, "", 40), (2, "1-5000", 40), (None, "", 1)}
    stretches = linededup._stretches(df, "doc_id", "text", 50)  # a row per document and not per copy of it
    assert stretches.count() == 2


def test_intervals_against_sorted_suffixes(spark):
    """The runs of documents against longest common prefixes of neighbours in a sorted list of all suffixes."""
    rng = random.Random(11)
    block = [[f"b{b} line {i} has six words" for i in range(12)] for b in range(4)]
    rows = [(d, "\n".join(x for _ in range(3) for x in rng.choice(block)[rng.randint(0, 4):rng.randint(6, 12)])) for d in range(30)]
    docs = [text.split("\n") for _, text in rows]
    suffixes = sorted((lines[i:], d, i) for d, lines in enumerate(docs) for i in range(len(lines)))
    least, want = 18, defaultdict(set)  # three lines of six words
    start = 0
    for j in range(1, len(suffixes) + 1):
        common = 0
        if j < len(suffixes):
            common = next((n for n, (x, y) in enumerate(zip(suffixes[j - 1][0], suffixes[j][0])) if x != y),
                          min(len(suffixes[j - 1][0]), len(suffixes[j][0])))
        if common < least // 6:
            members = sorted((d, i) for lines, d, i in suffixes[start:j] if len(lines) >= least // 6)
            for d, i in members[1:]:
                want[d].update(range(i, i + least // 6))
            start = j
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: removed(r["removed"]) for r in linededup.dedup_lines(df, "doc_id", "text", min_words=least).collect()}
    assert got == {d: want[d] for d in range(len(rows))}


def test_odd_rows(spark):
    got = linededup.dedup_lines(frame(spark), "doc_id", "text", min_words=6)
    assert got.count() == len(ROWS) and got.columns.count("removed") == 1
    by_key = defaultdict(list)
    for r in got.collect():
        by_key[r["doc_id"]].append((r["text"], r["removed"]))
    assert by_key[1] == [(None, "")] and by_key[2] == [("", "")]
    assert by_key[3] == [(ROWS[2][1], "")] * 2 and by_key[4] == [("", "0-0")]  # equal rows are one document
    assert linededup.dedup_lines(frame(spark, []), "doc_id", "text").count() == 0
