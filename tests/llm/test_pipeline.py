"""The pipeline stage by stage against plain Python, and the queries on the smallest tables."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from snapledger.llm import packing, pipeline, queries
from tests.llm.odd import ROWS
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_linededup import brute as lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_the_smallest_tables(spark, small, tmp_path):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    benchmark = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = sorted(map(tuple, docs.collect()))
        out = stage(spark, docs, small)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(map(tuple, docs.collect()))
        texts = [(r[0], r[1]) for r in before]
        if name == "language":
            want = [r for r in before if r[1] and any(map(str.isalpha, r[1]))]
        elif name == "line_dedup":
            want = []
            for row, gone in zip(before, lines(texts, 50), strict=True):
                text = "\n".join(x for n, x in enumerate(row[1].split("\n")) if n not in gone)
                if not gone or text.strip():
                    want.append((row[0], text, *row[2:4], len(text)) if gone else row)
        elif name == "near_duplicates":
            first = {k for k, c, _, _ in classes(texts) if k == c}
            want = [r for r in before if r[0] in first]
        elif name == "decontaminate":
            bad = {k for k, _ in leaks(texts, benchmark)}
            want = [r for r in before if r[0] not in bad]
        else:
            pieces = Counter(r[0] for r in kept[name])
            ids = {k: len(packing.encoder()(t)) + 1 for k, t in texts}
            assert pieces == {k: -(-n // 2048) for k, n in ids.items()}
            continue
        assert kept[name] == sorted(want) and "text" in columns


def test_stages_take_odd_rows(spark, small):
    for rows in ([(k, t, "en", None, None) for k, t in ROWS], []):
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", `key` int, `removed` int")
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() <= len(rows)
        want = Counter()
        for key, text in [(r[0], r[1]) for r in rows]:
            tokens = len(packing.encoder()(text or "")) + 1
            want.update((key, piece) for piece in range(-(-tokens // 2048)))
        assert Counter((r["doc_id"], r["piece"]) for r in pipeline.pack(spark, docs, small).collect()) == want


def test_the_root_module_has_the_same_pipeline():
    assert (corpus_pipeline.STAGES, corpus_pipeline.ORACLE_SQL, corpus_pipeline.run) == (pipeline.STAGES, None, pipeline.run)


def test_rows_with_null_or_repeated_ids_are_told_by_their_text(spark, small):
    leak = spark.read.parquet(f"{small}/benchmark.parquet").select("text").orderBy("item_id").first()[0]
    own = lambda n: " ".join(f"w{n}x{j}" for j in range(40))
    rows = [(None, own(1), "a"), (None, own(2), "a"), (None, own(2), "b"), (7, own(3), "a"), (7, own(4), "a"), (7, own(3) + " end", "a"),
            (8, own(4), "a"), (None, own(5) + " " + leak, "a"), (7, leak, "a"), (9, own(4) + " end", "a")]
    docs = spark.createDataFrame([(k, t, "en", v, 1) for k, t, v in rows], SCHEMA)
    plain = lambda df: sorted(((r[0], r[1], r[3]) for r in df.collect()), key=str)
    third = min((own(3), own(3) + " end"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = [(None, own(1), "a"), (None, own(2), "a"), (7, third, "a"), (7, own(4), "a"), (None, own(5) + " " + leak, "a"), (7, leak, "a")]
    assert plain(pipeline.near_duplicates(spark, docs, small)) == sorted(want, key=str)
    assert plain(pipeline.decontaminate(spark, docs, small)) == sorted([r for r in rows if leak not in r[1]], key=str)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("pipeline", "op12_filter_audit")])
def test_queries_cover_whole_tables(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    table, key = next((t, k) for t, k in (("pages", "page_id"), ("embeddings", "vec_id"), ("documents", "doc_id")) if k in df.columns)
    got = {r[0] for r in df.select(key).collect()}
    every = {r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect()}
    assert got == every if name != "op9_decontamination" else got <= every


def test_the_audit_counts_every_document(spark, small):
    rows = queries.filter_audit(spark, small).collect()
    sizes = Counter(r["lang"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert Counter(r["part"] for r in rows) == {part: 600 for part in sizes}
    last = {(r["part"], r["filter_order"]): 0 for r in rows}
    for r in rows:
        last[r["part"], r["filter_order"]] += r["removed"] + (r["kept"] if r["step"] == 5 else 0)
    assert all(n == sizes[part] for (part, _), n in last.items())
