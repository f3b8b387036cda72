"""How document filters interact, from a sparse document-term matrix.

1. Documents are cut into shards of about ``SHARD_BYTES``. A shard is a sparse matrix in compressed rows
   whose columns are numbers of its own list of words, which is ordered by the words' hashes.
2. The lists are cut into hash buckets of about ``BUCKET_WORDS`` words each. A bucket numbers its words, list
   after list, and hands every list the numbers of its words back. Lists move as blocks; a word that stands
   in every document is one entry a shard.
3. A shard meets the global numbers of its words and becomes part of the corpus-wide matrix. Row sums are
   numbers of words, nonzero counts numbers of different words.
4. Each document gets its set of failed filters. Sets are counted per part of the corpus, and what every
   filter does in every order follows from these counts alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, running_starts, shuffled, text_or_empty, written
from snapledger.sources.local import local_frame

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: A shard ends with the document that takes it beyond this much text.
SHARD_BYTES = 1 << 23
#: Entries of all lists that a bucket of the dictionary has, about; it holds their different words.
BUCKET_WORDS = 1 << 20
#: Ranges of hashes that buckets are made of, and entries of a bucket that are numbered at a time.
SLICES, HELD_WORDS = 1 << 14, 1 << 22
#: Tokens of a shard that are sorted at a time; a longer document is sorted by itself.
SORTED_TOKENS = 1 << 17


def packed(values: np.ndarray, kind: str = "<i4") -> pa.Array:
    """Integers as one binary value, which Spark moves without looking at each of them."""
    return pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())


def unpacked(value: pa.Array, kind: str = "<i4") -> np.ndarray:
    """The integers of a row's packed value."""
    return np.frombuffer(value[0].as_buffer(), kind)


def _shard(number: int, keys: pa.Array, parts: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """One row: the documents' keys, parts and properties, their words by hash, and the matrix of local columns.

    A row's columns ascend and are written as the gaps between them. Integers are packed (`packed`). ``_cuts``: where in the list of words each
    of ``SLICES`` equal ranges of hashes begins.
    """
    split = pc.ascii_split_whitespace(texts)  # at \x20 and \x09 to \x0D; ends of a text may give empty pieces
    tokens, ends = split.flatten(), np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)
    full = pc.greater(pc.binary_length(tokens), 0)
    coded = tokens.filter(full).dictionary_encode()
    ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][ends]
    del split, tokens, full
    words = coded.dictionary.cast(pa.binary())
    hashes = np.fromiter((zlib.crc32(word.as_buffer()) for word in words), np.int64, len(words))
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words))
    cuts = np.searchsorted(hashes[order], (np.arange(SLICES) << 32) // SLICES)
    words = words.take(pa.array(order))
    indptr, gaps, counts = _rows(rank[coded.indices.to_numpy()], ends)
    del coded, hashes, order, rank
    raw = texts.cast(pa.binary()).to_pylist()
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return [pa.array([number]), whole(keys), whole(parts), whole(pc.utf8_length(texts).cast(pa.int64())),
            one(np.array([len(x) - len(x.translate(None, CAPITALS)) for x in raw], np.int64), pa.int64()),
            one([len(x) != len(x.translate(None, SYMBOLS)) for x in raw], pa.bool_()),
            one([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), whole(words),
            *[packed(x) for x in (cuts, indptr, gaps, counts)]]


def _rows(columns: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed rows from the column of every token, documents one after the other up to ``ends``.

    A row's columns ascend. It takes runs of documents, so that 64-bit cells of few tokens are held at a time.
    """
    width, indptr, gaps, counts = int(columns.max(initial=0)) + 1, [np.zeros(1, np.int64)], [], []
    at, done = 0, 0
    while at < len(ends):
        begin = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + SORTED_TOKENS, "right")))
        own = ends[at:to] - begin
        cells = np.repeat(np.arange(to - at), np.diff(own, prepend=0)) * width
        cells += columns[begin:begin + len(cells)]
        cells.sort()
        begins = np.flatnonzero(np.diff(cells, prepend=-1))
        counts.append(np.diff(begins, append=len(cells)).astype(np.int32))
        rows, found = np.divmod(cells[begins], width)
        heads = np.searchsorted(rows, np.arange(to - at + 1))
        gap = np.diff(found, prepend=0)
        first = np.unique(heads[:-1][heads[:-1] < heads[1:]])
        gap[first] = found[first]
        gaps.append(gap.astype(np.int32))
        indptr.append(heads[1:] + done)
        at, done = to, done + len(begins)
    none = np.zeros(0, np.int32)
    return np.concatenate(indptr), np.concatenate([none, *gaps]), np.concatenate([none, *counts])


def _shards(rows: DataFrame) -> DataFrame:
    """A row per shard; see `_shard`."""
    key, part = (rows.schema[c].dataType.simpleString() for c in ("_key", "_part"))
    schema = (f"_shard bigint, _keys array<{key}>, _parts array<{part}>, _points array<bigint>, _capitals array<bigint>, "
              "_symbols array<boolean>, _hashes array<binary>, _words array<binary>, _cuts binary, _indptr binary, "
              "_gaps binary, _counts binary")
    names = [field.split()[0] for field in schema.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(), dtype=np.int64)
            begin = 0
            while begin < len(batch):
                held = ends[begin - 1] if begin else 0
                end = min(len(batch), int(np.searchsorted(ends, held + SHARD_BYTES)) + 1)
                piece = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(_shard(number, *(piece.column(c) for c in ("_key", "_part", "_text"))), names)
                number, begin = number + 1, end

    return rows.mapInArrow(build, schema)


def _numbered(lists: DataFrame) -> DataFrame:
    """Per list (``_shard``) and bucket the ``_numbers`` of its words within the bucket, and from number ``_first`` up
    the words (``_new``) that no list before it had."""
    total = lists.agg(F.sum(F.size("_words"))).first()[0] or 0
    buckets = min(SLICES, max(1, -(-total // BUCKET_WORDS)))
    # Slices of the range of hashes, dealt over the buckets in runs.
    run = np.arange(buckets) * SLICES // buckets

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                shard = batch.slice(at, 1)
                words = shard.column("_words").flatten()
                bounds = np.r_[unpacked(shard.column("_cuts"))[run], len(words)].astype(np.int32)
                some = pa.array(np.diff(bounds) > 0)
                yield pa.RecordBatch.from_arrays(
                    [x.filter(some) for x in (pa.array(np.arange(buckets)), pa.array(np.full(buckets, shard.column("_shard")[0].as_py())),
                                              pa.ListArray.from_arrays(pa.array(bounds), words))], ["_bucket", "_shard", "_words"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, known = [], 0, {}
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                other = held and row.column("_bucket")[0] != held[0].column("_bucket")[0]
                if other or entries > HELD_WORDS:
                    yield _numbers(held, known, more=not other)
                    held, entries, known = [], 0, {} if other else known
                held.append(row)
                entries += len(row.column("_words").flatten())
        if held:
            yield _numbers(held, known, more=False)

    cuts = lists.select("_shard", "_words", "_cuts").mapInArrow(cut, "_bucket bigint, _shard bigint, _words array<binary>")
    return (cuts.repartition("_bucket").sortWithinPartitions("_bucket", "_shard")
            .mapInArrow(number, "_bucket bigint, _shard bigint, _numbers binary, _first int, _new array<binary>"))


def _numbers(rows: list[pa.RecordBatch], known: dict[bytes, int], more: bool) -> pa.RecordBatch:
    """Numbers for the lists of one bucket, going on from the ``known`` words, which are kept if ``more`` lists follow."""
    lists = pa.concat_arrays([row.column("_words") for row in rows])
    coded, first = lists.flatten().dictionary_encode(), len(known)
    numbers, new = coded.indices.to_numpy(), coded.dictionary
    if first or more:
        of = np.array([known.setdefault(word, len(known)) for word in coded.dictionary.to_pylist()], np.int32)
        numbers, new = of[numbers], new.filter(pa.array(of >= first))
    n, ends = len(rows), np.cumsum(lists.value_lengths().to_numpy())
    blobs = [x.astype("<i4").tobytes() for x in np.split(numbers, ends[:-1])]
    column = lambda name: pa.concat_arrays([row.column(name) for row in rows])
    return pa.RecordBatch.from_arrays(
        [column("_bucket"), column("_shard"), pa.array(blobs, pa.binary()),
         pa.array(np.full(n, first, np.int32)), pa.ListArray.from_arrays(pa.array([0] + [len(new)] * n, pa.int32()), new)],
        ["_bucket", "_shard", "_numbers", "_first", "_new"])


def _joined(df: DataFrame, key: str, text: str, part: str) -> tuple[DataFrame, DataFrame]:
    """Local shards beside the ``_numbers`` of their words, ready for `_matrix`, and the dictionary."""
    spark = df.sparkSession
    local = written(_shards(df.select(col(key).alias("_key"), col(part).alias("_part"), text_or_empty(text).alias("_text"))), "local-shards")
    numbered = written(_numbered(local), "word-numbers")
    # One number per bucket, of a size Spark knows.
    starts = running_starts(numbered.select("_bucket", F.size("_new").alias("_n")), "_bucket", "_n")
    starts = local_frame(spark, list(starts.items()), "_bucket bigint, _start bigint")
    placed = numbered.join(starts, "_bucket")
    words = placed.select("_start", "_first", F.posexplode("_new").alias("_at", "_word")).select(
        "_word", (F.col("_start") + F.col("_first") + F.col("_at")).alias("_number"))
    numbers = placed.groupBy("_shard").agg(F.sort_array(F.collect_list(F.struct("_bucket", "_start", "_numbers"))).alias("_numbers"))
    joined = local.drop("_words", "_cuts").join(shuffled(numbers), "_shard", "left")
    return joined, words


def document_term_matrix(df: DataFrame, key: str, text: str, part: str) -> tuple[DataFrame, DataFrame]:
    """The corpus as shards of one sparse matrix in compressed rows, and its dictionary.

    Dictionary: ``_word`` (UTF-8), ``_number`` (0 up, the column of the matrix). A shard has a row per
    document (``_keys``, ``_parts``; code points, capitals A-Z, whether it has a symbol, a hash of the text)
    and, packed as little-endian integers of 4, 8 and 4 bytes, ``_indptr``, ``_indices``, ``_counts``: the words of row i and how often they stand in it are at
    ``_indptr[i]`` to ``_indptr[i + 1]``. Words are what white space (\\x20, \\x09 to \\x0D) separates. Null
    text: the empty text, a row without words.
    """
    joined, words = _joined(df, key, text, part)
    kinds = dict(joined.dtypes) | {"_indices": "binary"}
    return joined.mapInArrow(_matrix, ", ".join(f"{c} {kinds[c]}" for c in _matrix_columns(joined.columns))), words


def _matrix_columns(columns: list[str]) -> list[str]:
    return ["_indices" if c == "_gaps" else c for c in columns if c != "_numbers"]


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards that have met the ``_numbers`` of their words, one at a time, as shards of the corpus-wide matrix."""
    for batch in batches:
        columns = _matrix_columns(batch.schema.names)
        for at in range(len(batch)):
            shard = batch.slice(at, 1)
            cuts = shard.column("_numbers").flatten()  # by bucket, so by hash, as the local columns are
            found = [np.frombuffer(x.as_buffer(), "<i4") + int(start.as_py())
                     for x, start in zip(cuts.field("_numbers"), cuts.field("_start"), strict=True)]
            indices = _global(shard, np.concatenate([np.zeros(0, np.int64), *found]))
            yield pa.RecordBatch.from_arrays([packed(indices, "<i8") if c == "_indices" else shard.column(c) for c in columns], columns)


def _global(shard: pa.RecordBatch, numbers: np.ndarray) -> np.ndarray:
    """The global columns of a shard's matrix: its gaps added up row by row and looked up."""
    indptr, total = unpacked(shard.column("_indptr")), np.cumsum(unpacked(shard.column("_gaps")), dtype=np.int64)
    before = np.r_[0, total][indptr[:-1]]
    local = total - np.repeat(before, np.diff(indptr))
    return numbers[local]


def _failures(joined: DataFrame) -> DataFrame:
    """Per document ``_key``, ``_part``, ``_hash`` and the filters A to D that it fails, as bits of ``_mask``.

    A shard of the matrix is judged where it is made: one Python worker a task, and no shard goes through Spark again.
    """
    key, part = (dict(joined.dtypes)[c].removeprefix("array<")[:-1] for c in ("_keys", "_parts"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _matrix(batches):
            values = lambda c: shard.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            indptr = unpacked(shard.column("_indptr")).astype(np.int64)
            sums = np.r_[0, np.cumsum(unpacked(shard.column("_counts")), dtype=np.int64)]
            words, different = sums[indptr[1:]] - sums[indptr[:-1]], np.diff(indptr)
            failed = [words < LEAST_WORDS, 100 * different < LEAST_DISTINCT * words,
                      100 * values("_capitals") > MOST_CAPITALS * values("_points"), values("_symbols").astype(bool)]
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(failed))
            yield pa.RecordBatch.from_arrays(
                [shard.column("_keys").flatten(), shard.column("_parts").flatten(), shard.column("_hashes").flatten(),
                 pa.array(mask.astype(np.int32))], ["_key", "_part", "_hash", "_mask"])

    return joined.mapInArrow(judge, f"_key {key}, _part {part}, _hash binary, _mask int")


def _effects(cells: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, from numbers of documents by set of failed filters.

    Every cell has its contribution to the 5 steps of the 120 orders, and cells are few.
    """
    n, mask, order, step = F.col("_n"), F.col("_mask"), F.col("_order"), F.col("_step")
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    own, before = bits(F.substr(order, step, F.lit(1))), bits(F.substr(order, F.lit(1), step - 1))
    fails, gone = mask.bitwiseAND(F.col("_own")) != 0, mask.bitwiseAND(F.col("_before")) != 0
    count = lambda condition: F.sum(F.when(condition, n).otherwise(0)).cast("long")
    # Of a document's failed filters each is the first in an equal share of all orders.
    share = n * F.floor(F.lit(factorial(len(FILTERS))) / F.bit_count(mask))
    return (cells.withColumn("_order", F.explode(orders)).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
            .withColumns({"_own": own, "_before": before})
            .groupBy(F.col("_part").alias("part"), order.alias("filter_order"), step.alias("step"))
            .agg(count(~gone & ~fails).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
                 count(mask == F.col("_own")).alias("unique_fails"), count(fails & ~gone & F.col("_good")).alias("good_lost"),
                 count(fails & ~gone & F.col("_toxic")).alias("toxic_lost"),
                 F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley")))


def filter_audit(df: DataFrame, labels: DataFrame, *, key: str, text: str, part: str, label_key: str, quality: str,
                 toxic: str) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters fail a document: A of under 200 words; B if less than half of its words are different; C if more
    than 3 % of its code points are A-Z; D if it holds one of ``#$%&*|``; E if a smaller key has the same
    text. Null text: the empty text, which fails A. Null part: the empty part. A null key is neither smaller
    nor larger than any other, and has no label. Rows of equal key and text are no copies of each other. A
    key with several labels counts as good (toxic) if one of them is 1. An empty table gives an empty result;
    other columns are ignored.
    """
    joined, _ = _joined(df, key, text, part)
    documents = written(_failures(joined), "failures")
    copied = written(documents.groupBy("_hash").agg(F.min("_key").alias("_low"), F.count(F.lit(1)).alias("_n"))
                     .where("_n > 1").select(F.col("_hash").alias("_copy"), "_low"), "copied-texts")
    known = written(labels.groupBy(col(label_key).alias("_of")).agg(
        F.max(F.coalesce(col(quality) == 1, F.lit(False))).alias("_q"), F.max(F.coalesce(col(toxic) == 1, F.lit(False))).alias("_t")),
        "labels")
    later = F.coalesce(F.col("_key") > F.col("_low"), F.lit(False))
    cells = (documents.join(shuffled(copied), F.col("_hash") == F.col("_copy"), "left")
             .join(shuffled(known), F.col("_key") == F.col("_of"), "left")
             .groupBy(F.coalesce(F.col("_part").cast("string"), F.lit("")).alias("_part"),
                      F.when(later, F.col("_mask").bitwiseOR(1 << 4)).otherwise(F.col("_mask")).alias("_mask"),
                      F.coalesce("_q", F.lit(False)).alias("_good"), F.coalesce("_t", F.lit(False)).alias("_toxic"))
             .agg(F.count(F.lit(1)).alias("_n")))
    return _effects(written(cells, "cells"))
