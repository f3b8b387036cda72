import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapledger.llm import langid
from tests.llm.odd import ROWS, frame


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))


@pytest.fixture(scope="module")
def model(documents):
    return langid.train(documents.where("NOT held_out"), key="doc_id", text="text", lang="lang")


def test_held_out_accuracy(documents, model):
    rows = langid.predict_language(documents.where("held_out"), model).collect()
    assert rows and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["lang"]]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_first_then_shorter_grams():
    model = langid.Model(["aa", "bb"], {"hello": 0}, np.log([[0.9, 0.1]]), {"^wor": 0, "wo": 1, "z": 2},
                         np.log([[0.2, 0.8], [0.9, 0.1], [0.7, 0.3]]))
    scorer = langid.Scorer(model)
    assert scorer.predict("hello")[0] == "aa"
    assert scorer.predict("world")[0] == "bb"  # the 4-gram decides, the shorter one is not looked at
    assert scorer.predict("swor")[0] == "aa"
    assert scorer.predict("xz") == ("aa", pytest.approx(0.7))
    assert scorer.predict("qqq") == ("aa", 0.5)


def plain_model(rows):
    """Counts of words, and of n-grams of words, by language; with logarithms of their frequencies."""
    words, grams = Counter(), Counter()
    for text, lang in rows:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            words[word, lang] += 1
    for (word, lang), n in words.items():
        padded = f"^{word}$"
        for gram in {padded[i:i + k] for k in (1, 2, 3, 4) for i in range(max(1, len(padded) - k + 1))}:
            grams[gram, lang] += n
    languages = sorted({lang for _, lang in rows})
    tables = []
    for counts in (words, grams):
        known = {entry for entry, _ in counts}
        total = {lang: sum(n for (_, of), n in counts.items() if of == lang) + 0.5 * max(1, len(known)) for lang in languages}
        tables.append({entry: {lang: math.log((counts[entry, lang] + 0.5) / total[lang]) for lang in languages} for entry in known})
    return languages, *tables


def plain_scores(text, languages, words, grams):
    """The mean score of a text's words in every language, word by word."""
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    sums = dict.fromkeys(languages, 0.0)
    for word in found:
        entries, padded = [words[word]] if word in words else [], f"^{word}$"
        for k in (4, 3, 2, 1):
            entries = entries or [grams[g] for g in {padded[i:i + k] for i in range(len(padded) - k + 1)} if g in grams]
        for lang in languages:
            sums[lang] += sum(e[lang] for e in entries) / len(entries) if entries else 0.0
    return {lang: value / max(1, len(found)) for lang, value in sums.items()}


def test_against_plain_version(documents, model):
    learned = [(r["text"], r["lang"]) for r in documents.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL").collect()]
    plain = plain_model(learned)
    assert model.languages == plain[0] and set(model.words) == set(plain[1]) and set(model.grams) == set(plain[2])
    rows = langid.predict_language(documents, model).collect()
    for row in rows:
        if row["lang_pred"] == "und":
            assert not any(map(str.isalpha, row["text"] or ""))
            continue
        mean = plain_scores(row["text"], *plain)
        best = max(mean.values())
        assert mean[row["lang_pred"]] == pytest.approx(best)
        assert row["score"] == pytest.approx(1 / sum(math.exp(m - best) for m in mean.values()))
    # Not all texts are equally sure.
    assert len({round(r["score"], 2) for r in rows if r["lang_pred"] != "und"}) > 5


def test_odd_rows(spark, model):
    got = langid.predict_language(frame(spark), model)
    assert got.count() == len(ROWS) and got.columns.count("score") == 1
    for row in got.collect():
        if row["text"] is None or not any(map(str.isalpha, row["text"])):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] in model.languages
    nothing = langid.train(frame(spark, [], ("doc_id", "text", "lang"), ("bigint", "string", "string")), key="doc_id", text="text", lang="lang")
    assert {r["lang_pred"] for r in langid.predict_language(frame(spark), nothing).collect()} == {"und"}
    assert langid.predict_language(frame(spark, []), model).count() == 0
