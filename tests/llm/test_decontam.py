import random
import re
from collections import Counter

from snapledger.llm import decontam
from tests.llm.odd import frame


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(documents, items, threshold=0.8):
    """Best similarity of any item-sized window, over all windows of all documents."""
    out = {}
    for key, text in documents:
        have = words(text)
        for item, wanted in items:
            want = words(wanted)
            n = min(5, len(want))
            if not n or len(have) < n:
                continue
            count = lambda w: Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))  # noqa: B023, E731
            a, best = count(want), 0
            for length in {len(want), *range(max(n, len(want) - 8), len(want))}:
                for start in {0, max(0, len(have) - length)} if length < len(want) else range(max(1, len(have) - length + 1)):
                    b = count(have[start:start + length])
                    both = sum((a & b).values())
                    best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= threshold:
                out[key, item] = max(best, out.get((key, item), 0))
    return out


def run(spark, documents, items):
    df = decontam.leaks(documents, items, key="doc_id", text="text", item_key="item_id", item_text="text")
    return {(r["key"], r["item"]): r["similarity"] for r in df.collect()}


def test_against_all_windows(spark):
    rng = random.Random(5)
    made = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(made(rng.randint(12, 50)))) for i in range(12)] + [(90, "short one"), (91, "Four, plain words. Here"), (92, None), (93, "!!")]
    documents = []
    for i in range(60):
        passage = words(items[i % 12][1])
        if i % 4 == 1:
            passage = [w.upper() + "!" for w in passage]
        if i % 4 == 2:
            passage = passage[2:]
        if i % 4 == 3:
            passage = passage[:len(passage) // 2]
        documents.append((i, " ".join(made(rng.randint(0, 30)) + passage + made(rng.randint(0, 30)))))
    documents += [(100, "a short one"), (101, "four plain words here"), (102, None), (103, items[0][1]), (103, items[0][1])]
    want = brute(documents, items)
    got = run(spark, frame(spark, documents), frame(spark, items, ("item_id", "text")))
    assert len(want) > 30 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_windows_between_the_diagonals_of_hits(spark):
    """Words inserted in the middle and lost at the ends, or moved: the best window starts on no shared n-gram's diagonal."""
    cases = [(59, 1, 2), (100, 3, 6), (200, 8, 16)]
    items = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, (n, _, _) in enumerate(cases)]
    documents = []
    for i, (n, lost, more) in enumerate(cases):
        have = items[i][1].split()[lost:n - lost]
        have[len(have) // 2:len(have) // 2] = [f"new{j}" for j in range(more)]
        documents.append((i, " ".join([f"a{j}" for j in range(300)] + have + [f"b{j}" for j in range(300)])))
    swapped = items[1][1].split()
    documents.append((9, " ".join(["a"] * 40 + swapped[50:] + swapped[:50] + ["b"] * 40)))
    want = brute(documents, items)
    got = run(spark, frame(spark, documents), frame(spark, items, ("item_id", "text")))
    assert want.keys() == {(0, 0), (1, 1), (2, 2), (9, 1)} and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_very_long_texts_null_keys_and_repeated_rows(spark):
    item = " ".join(f"w{j}" for j in range(40))
    long = " ".join(f"own{j % 5_003}" for j in range(120_000))
    documents = [(1, f"{long} {item} {long}"), (None, f"{long} {item}"), (2, long), (None, "nothing of it"), (3, "x" * 300_000)] + [(4, item)] * 30
    assert run(spark, frame(spark, documents), frame(spark, [(7, item), (None, None)], ("item_id", "text"))) == {(1, 7): 1.0, (None, 7): 1.0, (4, 7): 1.0}


def test_search_finds_every_fingerprint_in_the_radius(spark):
    """Items are filed so that up to 31 of 128 changed bits still meet in a block."""
    rng = random.Random(6)
    near = {x for x in range(1 << 16) if x.bit_count() <= decontam.RADIUS // decontam.BLOCKS}
    for _ in range(300):
        flipped = rng.sample(range(128), decontam.RADIUS)
        parts = [sum(1 << b % 16 for b in flipped if b // 16 == block) for block in range(8)]
        assert any(part in near for part in parts)


def test_empty(spark):
    none = frame(spark, [], ("item_id", "text"))
    assert run(spark, frame(spark), none) == {}
    assert run(spark, frame(spark, []), frame(spark, [(1, "a b c d e f")], ("item_id", "text"))) == {}
    assert run(spark, frame(spark), frame(spark, [(1, "one two three four five six seven")], ("item_id", "text"))).keys() == {(3, 1), (4, 1)}
