"""Language identification by words first, then by ever shorter character n-grams.

A word that was seen in training scores by its log frequency in each language. An unseen word falls
back to its character n-grams of length 4; if none of them is known to 3, then 2, then 1. A text's
language is the one with the greatest sum over all its words.

Training counts on a sample that holds at most about ``max_documents`` documents per language (a
parameter). The model keeps every word and n-gram of these documents, so it is as large as they make it,
however large the corpus is, and is broadcast. Prediction covers every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, free_name, written

UNDETERMINED = "und"
MAX_DOCUMENTS = 2_000
LONGEST = 4
WORD = re.compile(r"[^\W\d_]+")
#: Unseen words of a worker that are remembered at a time.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Model:
    """Languages, and per word and n-gram its row in a table of log frequencies by language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def _sample(labelled: DataFrame, max_documents: int) -> DataFrame:
    """At most about so many rows of each language, picked by a hash, so the same ones every time."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled
    scale = 1 << 30
    keep = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(scale, max_documents * scale // n)))
                        for lang, n in sorted(counts.items())])
    return labelled.where(F.pmod(F.xxhash64("key", "text"), F.lit(scale)) < keep)


def _scores(rows: pa.Table, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The entries' places, and their log frequencies in each language, from columns ``lang``, ``entry``, ``n``."""
    coded = rows["entry"].combine_chunks().dictionary_encode()
    place = {lang: i for i, lang in enumerate(languages)}
    langs = rows["lang"].combine_chunks().dictionary_encode()
    column = np.array([place[lang] for lang in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
    counts = np.zeros((len(coded.dictionary), len(languages)))
    np.add.at(counts, (coded.indices.to_numpy(), column), rows["n"].to_numpy())
    total = counts.sum(axis=0) + 0.5 * max(1, len(counts))
    counts += 0.5
    counts /= total
    return {entry: i for i, entry in enumerate(coded.dictionary.to_pylist())}, np.log(counts, out=counts)


def train(labelled: DataFrame, *, key: str, text: str, lang: str, max_documents: int = MAX_DOCUMENTS) -> Model:
    """A model from rows with a text and a language; rows that lack either are left out.

    Counting runs in Spark on the sample; only the model's entries come to the driver.
    """
    rows = labelled.select(col(key).alias("key"), col(text).cast("string").alias("text"),
                           col(lang).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    picked = _sample(rows, max_documents)
    words = written(picked.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
                    .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(LONGEST)),
        lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))),
                              lambda at: F.substr(padded, at, n))))
    languages = [row[0] for row in words.select("lang").distinct().orderBy("lang").collect()]
    gram_rows = (words.select("lang", "n", F.explode(F.array_distinct(grams)).alias("entry"))
                 .groupBy("lang", "entry").agg(F.sum("n").alias("n")).orderBy("entry", "lang"))
    word_rows = words.select("lang", F.col("word").alias("entry"), "n").orderBy("entry", "lang")
    # As columns, one after the other: rows of Python objects would take many times the room.
    word_index, word_scores = _scores(word_rows.toArrow(), languages)
    gram_index, gram_scores = _scores(gram_rows.toArrow(), languages)
    return Model(languages, word_index, word_scores, gram_index, gram_scores)


class Scorer:
    """Scores words with a model; unseen ones are worked out once and remembered for a while."""

    def __init__(self, model: Model):
        self.model, self.unseen = model, {}

    def back_off(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest n-grams of which any is known; zeros if none is."""
        known = self.unseen.get(word)
        if known is not None:
            return known
        padded, grams = f"^{word}$", self.model.grams
        score = np.zeros(len(self.model.languages))
        for n in range(LONGEST, 0, -1):
            rows = [grams[g] for g in {padded[i:i + n] for i in range(len(padded) - n + 1)} if g in grams]
            if rows:
                score = self.model.gram_scores[rows].mean(axis=0)
                break
        if len(self.unseen) >= REMEMBERED:
            self.unseen.clear()
        self.unseen[word] = score
        return score

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure that is: the share of probability that the average word gives it."""
        languages = self.model.languages
        if text is None or not languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        place, total, rows = self.model.words, np.zeros(len(languages)), []
        words = WORD.findall(text.lower())
        for word in words:
            row = place.get(word)
            if row is None:
                total = total + self.back_off(word)
            else:
                rows.append(row)
        if rows:
            total = total + self.model.word_scores[rows].sum(axis=0)
        best = int(total.argmax())
        return languages[best], float(1 / np.exp((total - total[best]) / max(1, len(words))).sum())


def predict_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (columns of these names are replaced).

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to
    the language that sorts first. The score is the winner's share of probability for a word of average
    evidence: a sum over words would make it 1 for any text of some length. Texts of any length are read whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame([scorer.predict(x) for x in batch], columns=["lang_pred", "score"])

    found = free_name(df, "_found")
    return (df.withColumn(found, predict(col(text).cast("string")))
            .withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(found))


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 5, is 0. A null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))

