import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from snapledger.llm import packing
from tests.llm.odd import ROWS, frame

REAL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.sampled_from(["<|endoftext|> a", "a" * 3000, " " * 500, "\n\n \t", "é́ नि 🙂"]))
def test_ids_are_those_of_the_tokenizer(text):
    assert packing.encoder()(text) == REAL.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_every_piece_once_without_gaps(lengths):
    plan, seen, bins = packing.plan_packing(Counter(lengths), 40, groups=5), Counter(), defaultdict(list)
    for length in lengths:
        first, begin, at = plan.runs[length]
        run = np.searchsorted(first, seen[length], side="right") - 1
        bins[begin[run] + seen[length] - first[run]].append((at[run], length))
        seen[length] += 1
    assert len(bins) == plan.sequences
    for placed in bins.values():
        end = 0
        for at, length in sorted(placed):
            assert at == end
            end += length
        assert end <= 40
    assert plan.sequences <= 1.5 * -(-sum(lengths) // 40) + 2


def test_plan_is_close_to_the_bound():
    lengths = np.minimum(np.random.default_rng(2).lognormal(6.2, 1.2, 20_000).astype(int) + 1, 2048)
    plan = packing.plan_packing(Counter(lengths.tolist()))
    assert plan.sequences <= 1.02 * lengths.sum() / 2048


def test_cut():
    assert list(packing.cut([1] * 5, 2)) == [(0, 1), (1, 2), (3, 2)]
    assert list(packing.cut([1] * 4, 2)) == [(0, 2), (2, 2)]
    assert list(packing.cut([1], 2)) == [(0, 1)]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_odd_rows(spark, rows):
    got = [r.asDict() for r in packing.pack(frame(spark, rows)).collect()]
    want = Counter()
    for key, text in rows:
        ids = REAL.encode(text or "", add_special_tokens=False).ids + [0]
        for i, (start, n) in enumerate(packing.cut(ids, 2048)):
            want[key, i, start, n, zlib.crc32(array("I", ids[start:start + n]).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in places.values():
        placed.sort()
        assert [at for at, _ in placed] == [0, *np.cumsum([n for _, n in placed])[:-1]]
        assert sum(n for _, n in placed) <= 2048
