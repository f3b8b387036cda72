import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapledger.llm import veccode
from tests.llm.odd import frame

TYPES = ("bigint", "array<double>", "int")
COLUMNS = ("vec_id", "embedding", "label")


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over plain integers, no transform."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = -(-max((len(r[1]) for r in kept), default=0) // parts)
    cut = []
    for _, v, _ in kept:
        whole = [math.floor(Fraction(x) * 256) for x in v] + [0] * (parts * length - len(v))
        cut.append([tuple(whole[p * length:(p + 1) * length]) for p in range(parts)])
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        found = [[near(p, v[p]) for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found, strict=True) if f[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    out = []
    for (key, _, label), v in zip(kept, cut, strict=True):
        f = [near(p, v[p]) for p in range(parts)]
        out.append((key, "".join(f"{e:02x}" for e in f), sum(far(v[p], books[p][f[p]]) for p in range(parts)), label))
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    limit = lambda x: x if x < 1 << 63 else None
    return sorted(((k, c, limit(e), limit(sums[label]), digest) for k, c, e, label in out), key=repr)


def run(spark, rows, **options):
    got = veccode.compress(frame(spark, rows, COLUMNS, TYPES), "vec_id", "embedding", "label", **options)
    return sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize(("dimensions", "count"), [(64, 300), (48, 90), (16, 40), (5, 70)])
def test_against_plain_loops(spark, dimensions, count):
    rng = np.random.default_rng(dimensions)
    rows = [(int(k), rng.normal(0, 0.2, dimensions).tolist(), int(k) % 3 or None) for k in rng.permutation(count)]
    assert run(spark, rows) == brute(rows)


def test_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), rng.integers(-2, 3, 32).astype(float).tolist(), 1) for k in range(200)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (7, rows[9][1], 2), (None, None, None), (900, None, 1), (901, [], 1),
             (902, [0.5, float("nan")] + [0.0] * 30, 1), (903, [float("inf")] * 32, 1), (904, [None] * 32, 1), (905, [0.1] * 7, 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [], 1), (2, [], None)]) == brute([(1, [], 1), (2, [], None)])
    assert run(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e12, 1e30])
def test_components_beyond_64_bits(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(0, 1, 32) * scale).tolist(), k % 2) for k in range(80)]
    assert run(spark, rows, entries=8) == brute(rows, entries=8)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 20), st.integers(0, 10_000))
def test_transform_scales_distances_exactly(length, count, seed):
    rows = np.random.default_rng(seed).integers(-3, 4, (count, length))
    size = 1 << max(0, length - 1).bit_length()
    far = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    moved = veccode.transformed(rows)
    assert (((moved[:, None] - moved[None]) ** 2).sum(axis=2) == size * far).all()
    index, distance = veccode.nearest(moved, moved[: 1 + count // 2])
    assert (index == far[:, : 1 + count // 2].argmin(axis=1)).all()
    assert (distance == size * far[:, : 1 + count // 2].min(axis=1)).all()


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_sequency(size):
    rows = veccode.transformed(np.eye(size, dtype=np.int64)).T
    assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(size))


def test_too_many_entries(spark):
    with pytest.raises(ValueError, match="256"):
        run(spark, [], entries=257)
