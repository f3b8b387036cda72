import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapledger.llm import pii
from tests.llm.odd import ROWS, frame

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15 or \
                    kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            out.append((m.start(), pii.BASE.index(kind), m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def found(spark, rows):
    got = pii.personal_data(frame(spark, rows), "doc_id", "text").collect()
    return {r["key"]: [(s["start"], s["end"], s["kind"], s["base"]) for s in r["spans"]] for r in got}


SEEDS = ["a@b.c_d@e.f", "a@b.c.d@e.f.", "x..y@z", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "0001.2.03.255", "1.2.3.4.256.1.1.1", "4111 1111-1111 1111",
         "4111111111111111 1", "+1 (2) 3.4-5 6 7 8 9 0", "+1 555-1", "++49 (0)151 2345678 ", "é 4539578763621486ñ", "1-2--3", "+12345678901234567",
         "4539578763621486 4539578763621486", "4 5 3 9 5 7 8 7 6 3 6 2 1 4 8 6", "+4 5 3 9 5 7 8 7 6", "+1+1 555 555 5555", "a@b@c.d", "-1.1.1.1-", "@a.b",
         "a%b@c-d.e-f", "🙂 12.34.56.78 x@y.zz"]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = np.random.default_rng(7)
    pool = list("019. -+@ab_é()") + ["4111111111111111", "1.2.3.4", "a@b.c", "+1 555 555 5555", "\n"]
    rows = [(i, t) for i, t in enumerate([*SEEDS, *("".join(rng.choice(pool, rng.integers(1, 40))) for _ in range(3000))])]
    got = found(spark, rows)
    for key, text in rows:
        assert [(s, e, k) for s, e, k, sure in got[key] if sure] == base(text), text


def test_very_long_runs(spark):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "a." * 50_000 + "@b" + ".c" * 50_000), (4, "1 " * 100_000), (5, "+1" + " ()" * 60_000),
            (6, "1." * 30_000), (7, "token=" * 30_000)]
    got = found(spark, rows)
    assert [(s, e, k) for s, e, k, sure in got[3] if sure] == base(rows[2][1]) and not [x for x in got[2] if x[3]]


def test_long_secrets_are_covered_to_their_end(spark):
    rows = [(i, f"config key: token = {'eyJhbGciOi' * 60}{i:02d} end") for i in range(60)]
    got = found(spark, rows)
    for i, text in rows:
        assert [(s, e) for s, e, k, _ in got[i] if k == "secret"] == [(text.index("token"), len(text) - len(" end"))]


def test_labelers_add_what_the_base_lacks(spark):
    rows = [(i, f"config key: password=a1b2c3d4e5f6{i:02d} and write to joe{i} (at) mail.example (dot) com, call 212-555-01{i:02d}.") for i in range(60)]
    rows += [(100 + i, f"plain text number {i} mail x{i}@y.com") for i in range(60)]
    got = found(spark, rows)
    assert all({k for _, _, k, sure in got[i] if not sure} >= {"secret", "masked_email"} for i in range(60))
    assert all([k for _, _, k, _ in got[100 + i]] == ["email"] for i in range(60))


def with_check_digit(number):
    return next(number + d for d in "0123456789" if luhn(number + d))


def test_cards_beside_other_digits_are_added(spark):
    rng = np.random.default_rng(11)
    cards = [with_check_digit("4" + "".join(map(str, rng.integers(0, 10, 14)))) for _ in range(120)]
    spaced = lambda c: " ".join(c[i:i + 4] for i in range(0, 16, 4))
    wrong = lambda c: c[:-1] + str((int(c[-1]) + 5) % 10)
    rows = [(i, f"pay {a} {b} now") for i, (a, b) in enumerate(zip(cards[:40], cards[40:80], strict=True))]
    rows += [(100 + i, f"pay {spaced(c)} 12 times") for i, c in enumerate(cards[80:100])]
    rows += [(200 + i, f"pay {wrong(c)} {wrong(c)} now") for i, c in enumerate(cards[100:])]
    got = found(spark, rows)
    for key, text in rows:
        numbers = [m.span() for m in re.finditer(r"[0-9]{16}|[0-9]{4}(?: [0-9]{4}){3}", text)] if key < 200 else []
        sure = base(text)
        want = [x for x in numbers if not any(s < x[1] and x[0] < e for s, e, _ in sure)]
        assert [(s, e) for s, e, k, _ in got[key] if k == "card_in_run"] == want, text
        assert sure or want or key >= 200


def test_estimation_finds_the_good_labeler():
    rng = np.random.default_rng(8)
    truth = rng.random(5000) < 0.5
    votes = np.stack([np.where(rng.random(5000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.95, 0.8, 0.55)], axis=1)
    believed, rates = pii.estimate(np.zeros(5000, int), votes, np.ones(5000))
    assert rates[0, 1, 2] > rates[1, 1, 2] > rates[2, 1, 2] and ((believed > 0.5) == truth).mean() > 0.93


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.sampled_from(list(pii.LEVELS[f])) for f in pii.FEATURES], st.integers(1, 10**9)), min_size=1, max_size=20))
def test_fit_takes_any_counts(rows):
    weights = pii.fit([dict(zip([*pii.FEATURES, "n"], row, strict=True)) for row in rows])
    assert all(np.isfinite(w) for w in weights.values())


@pytest.mark.parametrize("rows", [ROWS, []])
def test_odd_rows(spark, rows):
    got = pii.personal_data(frame(spark, rows), "doc_id", "text")
    assert got.count() == len(rows)
    for row in got.collect():
        assert not [s for s in row["spans"] if s["base"]]
