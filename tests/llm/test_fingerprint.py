import hashlib

from pyspark.sql import functions as F

from snapledger.llm import fingerprint as fp
from tests.llm.odd import ROWS, frame


def vectors(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", fp.vector(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_order_insertion_and_deletion(spark):
    a, b, whole, turned, empty = vectors(spark, "One, two. Three", "Four!\nOne, two. Three", "One, two. Three\nFour!\nOne, two. Three",
                                         "Four!\nOne, two. Three\nOne, two. Three", "")
    assert whole == turned and set(empty) == {0}
    df = spark.createDataFrame([(a, b, whole)], "a array<long>, b array<long>, w array<long>")
    row = df.select(fp.combined(F.col("a"), F.col("b")).alias("sum"), fp.combined(F.col("w"), F.col("b"), -1).alias("rest")).first()
    assert row["sum"] == whole and row["rest"] == a


def test_likeness_estimates_shared_phrases(spark):
    one = [f"phrase {i} of many." for i in range(200)]
    for shared in (0, 50, 100, 200):
        other = one[:shared] + [f"another {i} thing." for i in range(200 - shared)]
        a, b = vectors(spark, " ".join(one), " ".join(other))
        df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        assert abs(df.select(fp.likeness(F.col("a"), F.col("b"))).first()[0] - shared / 200) < 0.25


def brute(rows):
    """Edited texts by key: next larger key (null first), its text whose beginning sorts first."""
    rank = lambda k: (k is not None, k or 0)
    keys = sorted({k for k, _ in rows}, key=rank)
    out = []
    for key, text in rows:
        text = text or ""
        following = keys[(keys.index(key) + 1) % len(keys)]
        need = max(len(t or "") // 2 for k, t in rows if k == key)
        half = len(text) // 2
        head = min((t or "")[:need].encode() for k, t in rows if k == following).decode()
        out.append((key, len(text), hashlib.sha256((text[:len(text) - half] + head[:half]).encode()).hexdigest()))
    return out


def test_odd_rows(spark):
    rows = fp.fingerprints(frame(spark).repartition(4), "doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == sorted(brute(ROWS), key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    texts = {r["n_chars"]: r["fingerprint"] for r in rows}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)}) == 1 and len(texts) > 5
    assert fp.fingerprints(frame(spark, []), "doc_id", "text").count() == 0
    single = fp.fingerprints(spark.createDataFrame([(1, "abc. def")], "doc_id long, text string"), "doc_id", "text").first()
    assert single["edited_sha256"] == hashlib.sha256(b"abc.abc.").hexdigest() and single["near_next"] == 1.0
