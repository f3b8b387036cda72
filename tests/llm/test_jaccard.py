import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from snapledger.llm import graph, jaccard
from tests.llm.odd import ROWS, frame


def brute(rows, threshold=0.8, words=5):
    """Class, links and copies per row: every pair of texts compared on its word n-grams."""
    texts = defaultdict(list)
    for key, text in rows:
        texts[text or ""].append(key)
    first = {t: min(keys, key=lambda k: (k is not None, k or 0)) for t, keys in texts.items()}
    sets = {t: {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if (w := t.lower().split()) else set() for t in texts}
    top, links, every = {t: t for t in texts}, Counter(), list(texts)

    def find(t):
        while top[t] != t:
            t = top[t]
        return t
    for i, a in enumerate(every):
        for b in every[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    classes = defaultdict(list)
    for t in texts:
        classes[find(t)].append(first[t])
    name = {c: min(keys, key=lambda k: (k is not None, k or 0)) for c, keys in classes.items()}
    return Counter((k, name[find(t or "")], links[t or ""], len(texts[t or ""])) for k, t in rows)


def run(df, **options):
    return Counter(map(tuple, jaccard.similarity_classes(df, "doc_id", "text", **options)
                       .select("doc_id", "class_id", "n_links", "n_copies").collect()))


def near_copies(seed, groups, size, length):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(length)] = f"v{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [256, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(1, 12, 5, 60) + [(1000 + k, t) for k, t in near_copies(2, 1, 70, 80)]
    rows += [(2000 + i, rows[0][1]) for i in range(50)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    assert run(frame(spark)) == brute(ROWS)
    assert run(frame(spark, [])) == Counter()


def test_pruning_limits_follow_the_posterior():
    for n, least in jaccard.fewest_matches(0.8, 1e-3, 48, 24):
        grid = np.linspace(0, 1, 20_001)
        for m, small in ((least, False), (least - 1, True)):
            density = grid ** m * (1 - grid) ** (n - m)
            assert (density[grid >= 0.8].sum() / density.sum() < 1e-3) == small


@pytest.mark.parametrize("many", [False, True])
def test_exact_verification(many):
    rng = np.random.default_rng(4)
    grams = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    left, right = (x[: None if many else 50] for x in np.triu_indices(40, 1))
    want = [len(np.intersect1d(grams[a], grams[b])) / len(np.union1d(grams[a], grams[b])) >= 0.5 for a, b in zip(left, right)]
    assert jaccard.verified(grams, left, right, 0.5).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 3), (9, 9)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_side_that_grows_with_the_corpus_is_broadcast(spark, monkeypatch):
    """Broadcast while it is small and shuffled later, a join of all nodes made the shuffle grow faster than the corpus."""
    plans, write = {}, jaccard.written

    def written(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)
    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(graph, "written", lambda df, label: written(df, label if label not in plans else f"{label} again"))
    rows = near_copies(3, 4, 5, 60)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    for label, key in (("bucket-members", "_bucket"), ("edges", "_id"), ("cluster-members", "_id"), ("linked", "_id"), ("classes", "_node")):
        assert f"SortMergeJoin [{key}#" in plans[label], label
