import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from snapledger.llm import simhash
from tests.llm.odd import LONG, ROWS, frame


def plain(text, words=4):
    """The fingerprint bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not parts:
        return 0
    grams = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(prints, radius=4):
    """For distinct fingerprints, the lowest of each one's component, by all pairs."""
    prints = sorted(set(prints))
    top = {p: p for p in prints}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                top[find(a)] = find(b)
    return {p: find(p) for p in prints}


def brute(rows):
    prints = [plain(t) for _, t in rows]
    of, members = connected(prints), defaultdict(list)
    for (key, _), p in zip(rows, prints, strict=True):
        members[of[p]].append(key)
    least = {c: min((k for k in keys if k is not None), default=None) for c, keys in members.items()}
    return Counter((key, f"{p:016x}", least[of[p]]) for (key, _), p in zip(rows, prints, strict=True))


def run(df):
    return Counter(map(tuple, simhash.near_duplicates(df, "doc_id", "text").select("doc_id", "fingerprint", "component_id").collect()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "Cc", "É", "é", "\x1c", "\x85", "x1", "İ", "ẞ"]), max_size=30),
       st.sampled_from([" ", "\n", "\t", "\x0b\x0c", " \r "]))
def test_fingerprint_bit_by_bit(words, gap):
    assert simhash.fingerprint(gap.join(words)) == plain(gap.join(words))


def test_fingerprint_of_a_long_text_is_read_in_blocks():
    text = " ".join(f"w{i * i % 7919}" for i in range(150_000))
    assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint(LONG) == plain(LONG)


@pytest.mark.parametrize(("radius", "leaf"), [(0, 64), (1, 256), (1, 16), (2, 64)])
def test_ball_never_leaves_the_reached_leaves(radius, leaf):
    plan, rng = simhash.tree(radius, leaf), np.random.default_rng(radius)
    every = np.arange(1 << 16)
    row, home = plan.reached(every, 0)
    assert sorted(row.tolist()) == every.tolist()
    of = np.empty(1 << 16, np.int64)
    of[row] = home
    assert np.bincount(of).max() <= leaf
    values = rng.integers(0, 1 << 16, 200)
    row, reached = plan.reached(values, radius)
    for i, value in enumerate(values.tolist()):
        ball = every[np.bitwise_count(every ^ value) <= radius]
        assert set(of[ball].tolist()) <= set(reached[row == i].tolist())
    assert len(reached) < 200 * 0.2 * (plan.leaf >= 0).sum()


def clustered(seed, clusters, size, flips, spread=1500):
    rng, prints = random.Random(seed), {rng.getrandbits(64) for rng in [random.Random(seed)] for _ in range(spread)}
    for _ in range(clusters):
        base = rng.getrandbits(64)
        for _ in range(size):
            now = base
            for bit in rng.sample(range(64), rng.randrange(flips + 1)):
                now ^= 1 << bit
            prints.add(now)
    return prints | {0, 1, 0b11110, (1 << 64) - 1, 1 << 63}


@pytest.mark.parametrize(("block", "pairs"), [(1 << 14, 1 << 20), (64, 500)])
@pytest.mark.parametrize("radius", [4, 3, 7])
def test_links_against_all_pairs(spark, monkeypatch, block, pairs, radius):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    prints = clustered(radius, 12, 12, 5, 600) | clustered(9, 1, 250, 3, 0)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "_fp bigint"), radius).collect()
    top = {p: p for p in signed}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p
    for a, b in found:
        top[find(a)] = find(b)
    got, want = defaultdict(set), defaultdict(set)
    for p in signed:
        got[find(p)].add(p)
    for p, c in connected(prints, radius).items():
        want[c].add(p - (1 << 64) if p >> 63 else p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(found) <= 40 * len(signed)


def test_documents_against_all_pairs(spark):
    rng, rows = random.Random(5), []
    for _ in range(25):
        base = [f"W{rng.randrange(400)}" for _ in range(rng.choice([2, 9, 60, 300]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "edit"
            rows.append((rng.randrange(1000), rng.choice([" ", "\n\n"]).join(words)))
    rows += [(2000 + i, rows[0][1].lower()) for i in range(40)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    assert run(frame(spark)) == brute(ROWS)
    assert run(frame(spark, [])) == Counter()
    assert run(frame(spark, [(None, "a b c"), (None, "A B C")])) == brute([(None, "a b c"), (None, "A B C")])
