"""Repeated runs of lines, found with a suffix array over line ids, and removed but for the first.

1. Every text is a sequence of line ids (128-bit hashes of its non-empty lines). Lines that occur
   once in the corpus end a sequence: no repeated run crosses them. Only stretches of repeated lines
   are looked at further. The documents that share a line are dealt over parts, and equal rows are
   taken once there, so neither a frequent line nor a repeated row is one task's work.
2. The suffixes of these stretches are sorted by prefix doubling. The rank of a suffix is the number
   of suffixes that sort before all those with the same first 2**k lines. A round pairs the ranks at
   p and p + 2**k, sorts the distinct pairs over the cluster, and sums their counts up into the ranks
   for 2**(k + 1) lines. Only distinct pairs with their counts are sorted, so a line that a third of
   all documents share is one row. Rounds go on up to the longest run that has to be told apart.
3. Neighbours in the suffix array that share their first m lines form a longest-common-prefix
   interval; the pair of ranks at p and p + m - 2**k names it (2**k <= m < 2**(k + 1)). Of each interval
   the first place in the corpus stays, by document key and line, and the others are later copies.
4. A repeated run counts from ``min_words`` words on. Every line of a longer run lies in a shortest run
   of that many words that begins or ends at some line of it, so m is the length of such a shortest
   run, which is at most ``min_words`` lines, and the copied runs together are the maximal repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, free_name, running_starts, shuffled, sorted_groups, text_or_empty, written

MIN_WORDS = 50
#: Parts that the documents sharing a line are dealt over, whatever their number.
PARTS = 16


def _ranked(pairs: DataFrame) -> DataFrame:
    """``r1``, ``r2``, ``rank`` of the distinct pairs of a frame, in their order, each weighing its count."""
    counted = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"))
    ordered = written(counted, "pairs").repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + batch["n"].cumsum()
            batch["rank"], batch["task"] = ends - batch["n"], task
            total = int(ends.iloc[-1]) if len(ends) else total
            yield batch

    summed = written(ordered.mapInPandas(add_up, "r1 bigint, r2 bigint, n bigint, rank bigint, task int"), "sums")
    starts = running_starts(summed, "task", "n")
    first = pairs.sparkSession.createDataFrame(list(starts.items()), "task int, first bigint")
    return summed.join(F.broadcast(first), "task").select("r1", "r2", (F.col("rank") + F.col("first")).alias("rank"))


def _shortest_runs(words: np.ndarray, least: int) -> set[tuple[int, int]]:
    """First line and number of lines of the shortest runs of ``least`` words from and to every line."""
    total = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:-1] + least)
    found = {(p, q - p) for p, q in enumerate(stop.tolist()) if q <= len(words)}
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    return found | {(q, p + 1 - q) for p, q in enumerate(start.tolist()) if q >= 0}


def _stretches(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """A row per stretch of repeated lines that has enough words: where it is, its line ids and shortest runs."""
    lines = (df.select(document(key, text).alias("d"), F.posexplode(F.filter(F.transform(
        F.split(text_or_empty(text), "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
        lambda x: x["line"].rlike(r"\S"))).alias("p", "z"))
        .select("d.*", "p", F.col("z.at").alias("at"), F.col("z.line").alias("line"))
        .select("known", "key", "hash", "p", "at", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"),
                F.regexp_count("line", F.lit(r"\S+")).alias("words")))
    lines = written(lines, "lines")
    place = ["known", "key", "hash"]
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    # A document lies in one part, so equal rows meet where they are joined and count once before they are moved.
    kept = (lines.withColumn("part", F.pmod("hash", F.lit(PARTS)).cast("int")).join(shuffled(repeated), ["h1", "h2", "part"])
            .groupBy("h1", "h2", "part", *place, "p").agg(F.first("at").alias("at"), F.first("words").alias("words")))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, out = TaskContext.get().partitionId() << 40, []
        for group in sorted_groups(batches, place):
            for part in np.split(np.arange(len(group["p"])), np.flatnonzero(np.diff(group["p"]) > 1) + 1):
                runs = sorted(_shortest_runs(group["words"][part], min_words))
                if runs:
                    out.append((number, *(group[c][0] for c in place), int(group["p"][part[0]]), *(group[c][part] for c in ("at", "h1", "h2")),
                                [{"at": a, "m": m} for a, m in runs]))
                    number += 1
            if len(out) > 1_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    schema = ("s bigint, known boolean, key bigint, hash bigint, p int, at array<int>, h1 array<bigint>, h2 array<bigint>, "
              "runs array<struct<at:int,m:int>>")
    names = [x.split()[0] for x in schema.split(", ")]
    return written(kept.repartition(*place).sortWithinPartitions(*place, "p").mapInPandas(gather, schema), "stretches")


def document(key: str, text: str) -> Column:
    """What identifies a document and its place in the corpus: the key (null first), then its text."""
    return F.struct(col(key).isNotNull().alias("known"), F.coalesce(col(key).cast("long"), F.lit(0)).alias("key"),
                    F.xxhash64(text_or_empty(text)).alias("hash"))


def later_copies(df: DataFrame, key: str, text: str, *, min_words: int = MIN_WORDS) -> DataFrame:
    """``document`` and ``runs`` of the documents with runs that occur earlier: first and last line of each.

    Lines are counted from 0; runs that touch or overlap are one.
    """
    stretches = _stretches(df, key, text, min_words)
    longest = stretches.agg(F.max(F.array_max(F.transform("runs", lambda r: r["m"])))).first()[0] or 0
    pairs = stretches.select("s", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "z")).select(
        "s", "i", F.col("z.h1").alias("r1"), F.col("z.h2").alias("r2"))
    found, span = None, 1
    while span <= longest:
        ranks = written(pairs.join(_ranked(pairs), ["r1", "r2"]).groupBy("s").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("ranks")), "ranks")
        here = F.filter("runs", lambda r: (r["m"] >= span) & (r["m"] < 2 * span))  # noqa: B023 - built at once
        named = (stretches.join(ranks, "s").select("known", "key", "hash", "p", "at", "ranks", F.explode(here).alias("r"))
                 .select("known", "key", "hash", (F.col("p") + F.col("r.at")).alias("p"), F.get("at", F.col("r.at")).alias("first"),
                         F.get("at", F.col("r.at") + F.col("r.m") - 1).alias("last"), F.col("r.m").alias("m"),
                         F.get("ranks", F.col("r.at")).alias("a"), F.get("ranks", F.col("r.at") + F.col("r.m") - span).alias("b")))
        found = named if found is None else found.union(named)
        pairs = (ranks.where(F.size("ranks") > span).select("s", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.size("ranks") - span - 1),
            lambda i: F.struct(F.get("ranks", i).alias("r1"), F.get("ranks", i + span).alias("r2")))).alias("i", "z"))  # noqa: B023
            .select("s", "i", "z.*"))
        span *= 2
    if found is None:
        found = stretches.select("known", "key", "hash", "p", F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(1).alias("m"),
                                 F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    found = written(found.withColumn("place", F.struct("known", "key", "hash", "first")), "runs")
    intervals = written(found.groupBy("m", "a", "b").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1"), "intervals")

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def joined_up(runs: pd.Series) -> pd.Series:
        return pd.Series([_union(x) for x in runs], dtype=object)

    return (found.join(intervals, ["m", "a", "b"]).where("place > earliest")
            .groupBy(F.struct("known", "key", "hash").alias("document"))
            .agg(F.array_sort(F.collect_set(F.struct("p", "m", "first", "last"))).alias("runs"))
            .select("document", joined_up("runs").alias("runs")))


def _union(runs: list) -> list[dict]:
    """Sorted runs put together where no line but empty ones lies between (``p`` and ``m`` leave those out)."""
    out: list[dict] = []
    end = -1
    for run in runs:
        if out and run["p"] <= end:
            out[-1]["last"] = max(out[-1]["last"], run["last"])
        else:
            out.append({"first": run["first"], "last": run["last"]})
        end = max(end, run["p"] + run["m"])
    return out


def dedup_lines(df: DataFrame, key: str, text: str, *, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with later copies of repeated runs taken out of ``text``, and ``removed``: what went.

    ``removed`` lists the stretches of removed lines as ``first-last``, counted from 0, or is empty.
    Empty lines between removed lines go with them. Null text stays null. The first copy stays whole: by
    key, null first, then by a hash of the text. Rows of equal key and text are one document and
    treated alike. Texts of any length are read whole; a task holds the repeated lines of one document at
    a time, as hashes. Columns of the result's names are replaced; keys are whole numbers.
    """
    copies = written(later_copies(df, key, text, min_words=min_words), "copies")
    kept = df.select(*[col(c) for c in df.columns if c != "removed" or c == text])
    d, r = free_name(kept, "_document"), free_name(kept, "_runs")
    joined = kept.withColumn(d, document(key, text)).join(
        shuffled(copies.select(F.col("document").alias(d), F.col("runs").alias(r))), d, "left")
    inside = lambda i: F.exists(F.col(r), lambda x: (i >= x["first"]) & (i <= x["last"]))
    left = F.array_join(F.filter(F.split(col(text), "\n", -1), lambda _, i: ~inside(i)), "\n")
    went = F.array_join(F.transform(F.col(r), lambda x: F.concat_ws("-", x["first"], x["last"])), ",")
    return joined.select(
        *[F.when(F.col(r).isNull(), col(c)).otherwise(left).alias(c) if c == text else col(c) for c in kept.columns],
        F.coalesce(went, F.lit("")).alias("removed"))
