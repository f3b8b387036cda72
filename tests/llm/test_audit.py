import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from snapledger.llm import audit
from tests.llm.odd import ROWS, frame

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """Every order is applied to every document."""
    judged = []
    for key, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": any(k is not None and key is not None and k < key and (t or "") == text for k, t, _ in rows)}
        own = [x for x in labels if x[0] == key and key is not None]
        judged.append((part or "", {f for f, bad in fails.items() if bad}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {j[0] for j in judged}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                all_fail = [j for j in judged if j[0] == part and f in j[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(all_fail) - len(gone), sum(j[1] == {f} for j in all_fail),
                                                   sum(j[2] for j in gone), sum(j[3] for j in gone)]
                shapley[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def run(spark, rows, labels):
    docs = frame(spark, rows, ("doc_id", "text", "lang"), ("bigint", "string", "string"))
    marks = frame(spark, labels, ("doc_id", "quality", "toxic"), ("bigint", "int", "int"))
    got = audit.filter_audit(docs, marks, key="doc_id", text="text", part="lang", label_key="doc_id", quality="quality", toxic="toxic").collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in got}
    assert len(found) == len(got)
    return found


def corpus(seed, count):
    rng, rows = random.Random(seed), []
    for key in range(count):
        size, pool = rng.choice([3, 150, 199, 200, 260, 400]), rng.choice([20, 90, 130, 5000])
        words = [f"w{rng.randrange(pool)}é" for _ in range(size)]
        if rng.random() < 0.3:
            words[rng.randrange(size)] = rng.choice(["#", "a|b", "*", "50%", "\x1c"])
        if rng.random() < 0.3:
            words = [w.upper() for w in words[: rng.randrange(size)]] + words
        rows.append((key, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words), rng.choice(["en", "de", None, ""])))
    rows += [(rng.randrange(2 * count), rng.choice(rows)[1], "en") for _ in range(count)]
    return rows


@pytest.mark.parametrize(("shard", "bucket"), [(1 << 23, 1 << 20), (3000, 100)])
def test_against_every_order_applied(spark, monkeypatch, shard, bucket):
    monkeypatch.setattr(audit, "SHARD_BYTES", shard)
    monkeypatch.setattr(audit, "BUCKET_WORDS", bucket)
    rows, rng = corpus(1, 60), random.Random(2)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 90)] + [(5, 1, 1), (None, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_odd_rows(spark):
    rows = [(k, t, lang) for (k, t), lang in zip(ROWS, ["en", None, "", "de"] * 4)]
    labels = [(3, 1, 1), (3, 0, None), (None, 1, 1), (5, None, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, [], labels) == {}


@pytest.mark.parametrize("bucket", [1 << 20, 50])
def test_matrix_holds_every_word_of_every_document(spark, monkeypatch, bucket):
    monkeypatch.setattr(audit, "SHARD_BYTES", 2000)
    monkeypatch.setattr(audit, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(audit, "HELD_WORDS", 3 * bucket // 10)
    rows = corpus(4, 30) + [(999, None, "en"), (998, " \t", "en")]
    shards, words = audit.document_term_matrix(frame(spark, rows, ("doc_id", "text", "lang"), ("bigint", "string", "string")),
                                               "doc_id", "text", "lang")
    known = {r["_number"]: bytes(r["_word"]).decode() for r in words.collect()}
    assert sorted(known) == list(range(len(known)))
    got, seen = defaultdict(Counter), Counter()
    for shard in shards.collect():
        indptr, indices, counts = (np.frombuffer(shard[c], k) for c, k in (("_indptr", "<i4"), ("_indices", "<i8"), ("_counts", "<i4")))
        assert indptr[0] == 0
        for i, key in enumerate(shard["_keys"]):
            seen[key] += 1
            row = slice(indptr[i], indptr[i + 1])
            got[key].update({known[c]: n for c, n in zip(indices[row].tolist(), counts[row].tolist(), strict=True)})
    want = defaultdict(Counter)
    for key, text, _ in rows:
        want[key] += Counter(WORD.findall(text or ""))
    assert {k: c for k, c in got.items() if c} == {k: c for k, c in want.items() if c}
    assert seen == Counter(k for k, *_ in rows)
    assert len(set(known.values())) == len(known)


def test_no_shard_passes_two_python_workers_of_a_task(spark, monkeypatch):
    """A second one beside the first, and the matrix in Arrow between them, took an executor beyond its memory."""
    plans, write = {}, audit.written

    def written(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)
    monkeypatch.setattr(audit, "written", written)
    rows = corpus(6, 20)
    assert run(spark, rows, []) == brute(rows, [])
    assert plans["failures"].count("MapInArrow") == 1


@pytest.mark.parametrize("held", [1, 7, 1 << 17])
def test_rows_of_a_shard_are_compressed_in_runs(monkeypatch, held):
    monkeypatch.setattr(audit, "SORTED_TOKENS", held)
    docs = [[], [3, 1, 3], [], [0], [5, 0, 5, 5, 2, 1, 0, 4], [], [3, 3, 1]]
    indptr, gaps, counts = audit._rows(np.array(sum(docs, []), np.int32), np.cumsum([len(d) for d in docs]))
    got = [{int(c): int(n) for c, n in zip(np.cumsum(gaps[a:b]), counts[a:b])} for a, b in zip(indptr, indptr[1:])]
    assert got == [dict(Counter(d)) for d in docs]
    assert [x.tolist() for x in audit._rows(np.zeros(0, np.int32), np.zeros(0, np.int64))] == [[0], [], []]
