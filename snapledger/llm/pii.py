"""Personal data in texts, by weak supervision over labelers that vote on candidate spans.

1. Candidates. Base kinds (e-mail, IP address, card, phone) by their patterns and checks; further
   kinds (secrets, masked e-mail, local phone, social security number, IBAN, a card number beside other
   digits, with which the plain pattern takes it for one long number) by looser patterns.
2. Labelers. Three vote yes, no or nothing on every candidate: a regex labeler on its form, a
   gazetteer labeler on lists of known parts, and a context labeler on the words just before it.
3. Expectation-maximisation over the votes estimates how often each labeler says what for true and
   false spans and how common true spans are in each kind; there are no given labels. Votes take few
   values, so only counts per combination reach the driver, at most ``81 * kinds * 12`` of them.
4. A logistic classifier is fitted to the resulting probabilities on votes, kind, length and share of
   digits, and decides about every candidate. Base spans that pass their checks stay in any case;
   others are added where the classifier says yes and no base span overlaps.

All passes over the data are built-in functions; there is no Python code in them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, let, text_or_empty, written

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "masked_email", "local_phone", "ssn", "iban", "card_in_run"]
# Patterns match what the plain ones do, with possessive repetition and look-behind in place of
# backtracking, so that very long runs take linear time and no deep recursion.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                 of 12 to 19 digits
#   phone \+[0-9][\x20().0-9-]+[0-9]            of 9 to 15 digits
# Card and phone matches are whole runs, so that their number of digits can be part of the pattern.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])",
}
#: Looser candidates of the further kinds, and which kind a match is: the first whose test it passes.
SECRET = r"(?i:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)"
LOOSE = "|".join([
    rf"(?<![A-Za-z]){SECRET}[\"']?\s{{0,3}}+[:=]\s{{0,3}}+[\"']?[^\s\"']{{6,}}+",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?: ?(?:[(\[{]dot[)\]}]|\.) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
    r"(?<![0-9])[0-9]{13,19}+(?![0-9])", r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
])
LOOSE_TESTS = {"secret": rf"^{SECRET}", "masked_email": r"[(\[{]at[)\]}]", "ssn": r"^[0-9]{3}-[0-9]{2}-",
               "local_phone": r"^\(?[0-9]{3}\)?[ .-][0-9]{3}", "iban": r"^[A-Z]{2}[0-9]{2}",
               "card_in_run": r"^[0-9]{13}|^[0-9]{4}[ -][0-9]{4}[ -]"}
# The gazetteers.
DOMAINS = "com org net edu gov mil int info biz io co ai app dev de fr es it nl be ch at uk ie us ca au nz jp cn in br mx pl se no dk fi pt eu".split()
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|37[0-7]|38[0-9]|42[01]|97[1-7]"
#: Cue words of each kind, and words that speak against any.
CUES = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel|schreib", "ip": r"\bip\b|server|host|address|addr|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta|amex", "phone": "phone|tel|call|fax|mobile|telefon|appel|llam",
    "secret": "login|user|key|config|credential", "masked_email": "e-?mail|mail|contact|write|kontakt|correo",
    "local_phone": "phone|tel|call|fax|mobile|telefon", "ssn": "ssn|social|security|insurance",
    "iban": "iban|bank|konto|account|compte|cuenta",
}
CUES["card_in_run"] = CUES["card"]
AGAINST = r"version|release|isbn|issn|order|invoice|part no|serial|section|chapter|\bv\.?\s*$|#\s*$"
#: What a text must hold for a match at all; quick to look for, so that most texts need no more.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{11}", "phone": "+"}
LOOSE_HINT = r"[:=]\s{0,3}+[\"']?[^\s\"']{6}|[(\[{]at[)\]}]|[0-9]{3}|[A-Z]{2}[0-9]{2}"
CONTEXT = 40
LENGTHS, SHARES = [12, 18, 26], [0.2, 0.6]


def spans(text: Column, pattern: str, hint: Column) -> Column:
    """Matches of a pattern in order: start and end in code points, text, and the text just before.

    Only texts for which ``hint`` holds can have any.
    """
    parts = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda between, hit: F.struct(
            F.length(between).alias("gap"), F.length(hit).alias("size"), F.right(between, F.lit(CONTEXT)).alias("context"),
            hit.alias("hit"))))
    none = F.array().cast("array<struct<start:int,end:int,hit:string,context:string>>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda done, x: F.struct(
        (done["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(done["out"], F.array(F.struct((done["at"] + x["gap"]).alias("start"),
                                               (done["at"] + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit"),
                                               x["context"].alias("context")))).alias("out")))["out"]
    return F.when(hint, found).otherwise(none)


def luhn(hit: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(hit, "[^0-9]", "")), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.zip_with(digits, F.sequence(F.lit(1), F.size(digits)), lambda d, i: F.when(i % 2 == 1, d)
                                   .when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _small_parts(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


#: What a base match has to pass beyond its pattern.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda h: F.lit(True), "ip": _small_parts, "card": luhn, "phone": lambda h: F.lit(True)}


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _by_kind(kind: Column, votes: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, vote in votes.items():
        out = F.when(kind == KINDS.index(name), vote).otherwise(out)
    return out


def form_vote(kind: Column, hit: Column) -> Column:
    """The regex labeler: does the match have the form of its kind in detail?"""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    number = lambda ok: _vote(ok, ~ok)
    value = F.regexp_replace(hit, rf"^{SECRET}[\"']?\s*[:=]\s*[\"']?", "")
    return _by_kind(kind, {
        "email": number(hit.rlike(r"\.[A-Za-z]{2,24}$") & ~hit.rlike(r"\.\.|^\.|\.@")), "ip": number(_small_parts(hit)),
        "card": number(luhn(hit)), "card_in_run": number(luhn(hit)), "phone": number(digits.between(10, 14)),
        "secret": number((F.length(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")),
        "masked_email": number(hit.rlike(r"[A-Za-z]{2,24}$")), "local_phone": number(hit.rlike(r"^\(?[2-9]")),
        "ssn": number(~hit.rlike("^(?:000|666|9)|-00-|-0000$")), "iban": number((digits >= 8) & (F.length(hit) >= 15))})


def gazetteer_vote(kind: Column, hit: Column) -> Column:
    """The gazetteer labeler: are its parts known ones?"""
    known = lambda pattern: _vote(hit.rlike(pattern), ~hit.rlike(pattern))
    domain = r"(?i)[.)\]}] ?(?:" + "|".join(DOMAINS) + ")$"
    return _by_kind(kind, {
        "email": known(domain), "masked_email": known(domain), "phone": known(rf"^\+(?:{CALLING})"),
        "card": known("^[3-6]"), "card_in_run": known("^[3-6]"), "iban": known("^(?:" + "|".join(COUNTRIES) + ")"),
        "ip": _vote(~hit.rlike(r"^(?:0|10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), F.lit(True)),
        "secret": _vote(hit.rlike("(?i)^(?:pass|pwd|token|secret)"), F.lit(False))})


def context_vote(kind: Column, context: Column) -> Column:
    """The context labeler: do the words before it speak for it or against it?"""
    return F.when(context.rlike(f"(?i){AGAINST}"), -1).otherwise(_by_kind(
        kind, {name: _vote(context.rlike(f"(?i){cue}"), F.lit(False)) for name, cue in CUES.items()}))


def candidates(text: Column) -> Column:
    """All candidate spans of a text with votes and features; ``base`` says which stay in any case."""
    def loose_kind(hit: Column) -> Column:
        return F.coalesce(*[F.when(hit.rlike(test), KINDS.index(name)) for name, test in LOOSE_TESTS.items()], F.lit(len(BASE)))

    def hinted(hint: str) -> Column:
        return text.contains(hint) if len(hint) == 1 else text.rlike(hint)

    def named(pattern: str, hint: str, kind: Callable[[Column], Column], base: Callable[[Column], Column]) -> Column:
        return F.transform(spans(text, pattern, hinted(hint)), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), x["context"].alias("context"),
            kind(x["hit"]).alias("kind"), base(x["hit"]).alias("base")))

    found = F.concat(*[named(PATTERNS[name], HINTS[name], lambda _, i=i: F.lit(i), CHECKS[name]) for i, name in enumerate(BASE)],
                     named(LOOSE, LOOSE_HINT, loose_kind, lambda _: F.lit(False)))
    # Digits beside a card number are no candidate unless they pass the check that cards have to.
    found = F.filter(found, lambda x: (x["kind"] != KINDS.index("card_in_run")) | luhn(x["hit"]))
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"),
        form_vote(x["kind"], x["hit"]).alias("form"), gazetteer_vote(x["kind"], x["hit"]).alias("gazetteer"),
        context_vote(x["kind"], x["context"]).alias("context"), _bucket(F.length(x["hit"]), LENGTHS).alias("length"),
        _bucket(F.length(F.regexp_replace(x["hit"], "[^0-9]", "")) / F.length(x["hit"]), SHARES).alias("digits")))


def _bucket(value: Column, limits: list) -> Column:
    return sum((F.when(value > limit, 1).otherwise(0) for limit in limits), F.lit(0))


def estimate(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: probability that spans with these votes are true, and the reliabilities.

    ``votes`` has -1, 0 or 1 per labeler. Reliabilities: per labeler, truth and vote, how often it votes so.
    """
    n = votes.shape[1]
    rates = np.tile(np.array([[0.45, 0.4, 0.15], [0.1, 0.4, 0.5]]), (n, 1, 1))  # labelers are better than chance at first
    prior = np.full(len(KINDS), 0.5)
    truth = np.full(len(counts), 0.5)
    for _ in range(rounds):
        log = np.stack([np.log(1 - prior[kinds]), np.log(prior[kinds])], axis=1)
        for j in range(n):
            log += np.log(rates[j][:, votes[:, j] + 1].T)
        log -= log.max(axis=1, keepdims=True)
        truth = np.exp(log[:, 1]) / np.exp(log).sum(axis=1)
        for j in range(n):
            for value in range(3):
                at = votes[:, j] + 1 == value
                rates[j, 0, value] = (counts[at] * (1 - truth[at])).sum() + 1
                rates[j, 1, value] = (counts[at] * truth[at]).sum() + 1
            rates[j] /= rates[j].sum(axis=1, keepdims=True)
        for kind in range(len(KINDS)):
            at = kinds == kind
            prior[kind] = ((counts[at] * truth[at]).sum() + 1) / (counts[at].sum() + 2)
    return truth, rates


FEATURES = ["kind", "form", "gazetteer", "context", "length", "digits"]
LEVELS = {"kind": range(len(KINDS)), "form": (-1, 0, 1), "gazetteer": (-1, 0, 1), "context": (-1, 0, 1),
          "length": range(len(LENGTHS) + 1), "digits": range(len(SHARES) + 1)}


def fit(rows: list, rounds: int = 30, ridge: float = 1.0) -> dict[tuple[str, int], float]:
    """Weights of the logistic classifier by feature and level, from counts per combination of levels."""
    table = np.array([[row[name] for name in FEATURES] for row in rows], dtype=int).reshape(len(rows), len(FEATURES))
    counts = np.array([row["n"] for row in rows], dtype=float)
    truth, _ = estimate(table[:, 0], table[:, 1:4], counts)
    names = [(name, level) for name in FEATURES for level in LEVELS[name]]
    design = np.stack([table[:, FEATURES.index(name)] == level for name, level in names], axis=1).astype(float)
    weights = np.zeros(len(names))
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-design @ weights))
        slope = design.T @ (counts * (truth - guess)) - ridge * weights
        bend = (design * (counts * guess * (1 - guess))[:, None]).T @ design + ridge * np.eye(len(names))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, weights.tolist(), strict=True))


def personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: ``key`` and ``spans``, an array of start, end (code points, end exclusive), kind and base, in order.

    Null text: the empty text, which has no spans. Repeated rows have equal spans and count as often
    as they occur when reliabilities are estimated. Base spans of different kinds may overlap. An empty
    table, or one without candidates, has nothing to learn from and none to add. Texts of any length are read
    whole, in linear time. A null key is carried through. Other columns are ignored.
    """
    found = written(df.select(col(key).alias("key"), candidates(text_or_empty(text)).alias("found")), "candidates")
    rows = (found.select(F.explode("found").alias("x")).select("x.*").groupBy(*FEATURES)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(*FEATURES).collect())
    weights = fit(rows) if rows else {}

    def believed(x: Column) -> Column:
        score = F.lit(0.0)
        for name in FEATURES:
            levels = [F.when(x[name] == level, F.lit(w)) for (feature, level), w in weights.items() if feature == name]
            score = score + (F.coalesce(*levels) if levels else F.lit(0.0))
        return score > 0

    base = F.filter("found", lambda x: x["base"])
    added = F.filter("found", lambda x: (x["kind"] >= len(BASE)) & believed(x) & ~F.exists(
        F.col("sure"), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    ordered = F.array_sort(F.transform(F.concat("sure", "added"), lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))))
    names = F.array(*[F.lit(name) for name in KINDS])
    return (found.withColumn("sure", base).withColumn("added", added)
            .select("key", F.transform(ordered, lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["kind"]).alias("kind"),
                x["base"].alias("base"))).alias("spans")))


def listed(found: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
