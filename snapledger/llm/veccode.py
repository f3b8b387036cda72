"""Vector compression by integer codebooks, compared in the Walsh-Hadamard domain.

Vectors are turned into integers and cut into equal parts; each part is replaced by the number of the
nearest entry of its position's codebook. Parts and entries are padded with zeros to a power of two, P,
and transformed by the integer Walsh-Hadamard transform, which multiplies every squared distance by
exactly P and gathers most of it in the coefficients of low sequency. Differences are squared and added
in that order; an entry goes as soon as its sum exceeds the whole distance of the row's most promising
entry. Only integers are compared, so ties and eliminations are exact.

A round of training reads the vectors once. A task returns one sum per codebook component, whatever it
has read, and the driver holds the codebooks only: entries x dimensions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows compared with all entries at a time.
CHUNK = 4096


def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Walsh-Hadamard matrix of a power-of-two size by their number of sign changes."""
    bits = size.bit_length() - 1
    gray = [k ^ (k >> 1) for k in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transformed(rows: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, padded with zeros, coefficients by sequency."""
    n, length = rows.shape
    size = 1 << max(0, length - 1).bit_length()
    out = np.zeros((n, size), rows.dtype)
    out[:, :length] = rows
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out[:, sequency_order(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties: the lowest) and its scaled squared distance.

    Both are transformed. All entries get their first coefficient; the best by it is worked out in full
    and bounds the rest, of which fewer are left after every coefficient.
    """
    index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    for at in range(0, len(parts), CHUNK):
        block = parts[at:at + CHUNK]
        difference = block[:, :1] - entries[None, :, 0]
        first = difference * difference
        bound = ((block - entries[first.argmin(axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(first <= bound[:, None])
        total = first[row, entry]
        for c in range(1, block.shape[1]):
            difference = block[row, c] - entries[entry, c]
            total = total + difference * difference
            keep = total <= bound[row]
            row, entry, total = row[keep], entry[keep], total[keep]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(total, starts)
        least = total == best[row]
        index[at:at + CHUNK] = entry[least][np.unique(row[least], return_index=True)[1]]
        distance[at:at + CHUNK] = best
    return index, distance


@dataclass(frozen=True)
class Shape:
    """How vectors become integers: ``length`` components a part, ``big`` where 64 bits would not do."""

    parts: int
    length: int
    big: bool

    @property
    def limbs(self) -> int:
        """Words of 32 bits that a sum of components is dealt over, so that sums of sums cannot overflow."""
        return 40 if self.big else 2

    @property
    def dtype(self) -> type:
        return object if self.big else np.int64

    def integers(self, column: pa.Array) -> np.ndarray:
        """Rows x parts x length: every component as floor(256 * x), short vectors padded with zeros."""
        width = self.parts * self.length
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if self.big:
            whole = np.array([math.floor(Fraction(x) * SCALE) for x in values.tolist()], dtype=object)
        else:
            whole = np.floor(values * SCALE).astype(np.int64)
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not (lengths == width).all():
            padded = np.zeros((len(column), width), self.dtype)
            padded[np.arange(width) < lengths[:, None]] = whole
            whole = padded
        return whole.reshape(len(column), self.parts, self.length)


def _batches(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as integers, a few million components at a time."""
    rows = max(1, (1 << 22) // max(1, shape.parts * shape.length))
    for batch in batches:
        for at in range(0, len(batch), rows):
            piece = batch.slice(at, rows)
            yield piece, shape.integers(piece.column("_vector"))


def _trained(rows: DataFrame, books: np.ndarray, shape: Shape) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts it is nearest to."""
    entries = books.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = [transformed(book) for book in books]
        counts = np.zeros((shape.parts, entries), np.int64)
        sums = np.zeros((shape.parts, entries, shape.length), shape.dtype)
        for _, vectors in _batches(batches, shape):
            for p in range(shape.parts):
                index, _ = nearest(transformed(vectors[:, p]), lookup[p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, vectors[:, p])
        part, entry, place = np.nonzero(np.broadcast_to((counts > 0)[:, :, None], sums.shape))
        total = sums[part, entry, place]
        low = [(total >> 32 * i) & 0xFFFFFFFF for i in range(shape.limbs - 1)]
        words = [w.astype(np.int64) for w in [*low, total >> 32 * (shape.limbs - 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, place, counts[part, entry], *words)], names)

    names = ["part", "entry", "place", "n", *[f"w{i}" for i in range(shape.limbs)]]
    totals = (rows.select("_vector").mapInArrow(add, ", ".join(f"{name} bigint" for name in names))
              .groupBy(*names[:3]).agg(*[F.sum(name).alias(name) for name in names[3:]]))
    books = books.copy()
    for row in totals.collect():  # at most entries x dimensions rows
        books[row["part"], row["entry"], row["place"]] = sum(row[f"w{i}"] << 32 * i for i in range(shape.limbs)) // row["n"]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str, vector: str, label: str, *, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """Per kept row its key, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    ``code``: two hexadecimal digits a part (at most 256 entries); ``error``: the squared distance of the
    integer vector from what its code stands for; ``label_error``: its sum over rows of the same label,
    nulls together. Rows are dropped whose vector is null or holds a null, NaN or infinity. The first
    codebooks are the parts of the rows with the smallest keys; a null key comes after all others, rows of
    one key go by their vectors. With fewer rows than entries the codebooks have as many entries as there
    are rows. Vectors shorter than the longest (its length rounded up to a multiple of ``parts``) count as
    padded with zeros. Components too large for 64-bit sums are worked out in unbounded integers; an error
    that is no long is null. Repeated rows have equal codes and count as often as they are there; an empty
    table gives an empty result; other columns are ignored. ``df`` is read ``rounds`` + 3 times.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    values = col(vector).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (df.where(values.isNotNull() & ~F.coalesce(bad, F.lit(True)))
            .select(col(key).alias("_key"), col(label).alias("_label"), values.alias("_vector")))
    longest, largest = rows.agg(F.max(F.size("_vector")), F.max(F.array_max(F.transform("_vector", F.abs)))).first()
    length = -(-(longest or 0) // parts)
    size = 1 << max(0, length - 1).bit_length()
    shape = Shape(parts, length, 4 * size ** 3 * (SCALE * Fraction(largest or 0) + 1) ** 2 >= 1 << 62)
    first = rows.orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    start = shape.integers(pa.array([row[0] for row in first], pa.list_(pa.float64())))
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        books = _trained(rows, books, shape)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = [transformed(book) for book in books]
        for piece, vectors in _batches(batches, shape):
            found = [nearest(transformed(vectors[:, p]), lookup[p]) for p in range(parts)]
            digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [digits[at:at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            error = sum(distance // size for _, distance in found).tolist()
            yield pa.RecordBatch.from_arrays(
                [piece.column("_key"), piece.column("_label"), pa.array(codes, pa.string()),
                 pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], names)

    names = ["_key", "_label", "_code", "_error"]
    kinds = dict(rows.dtypes)
    coded = written(rows.mapInArrow(encode, f"_key {kinds['_key']}, _label {kinds['_label']}, _code string, _error bigint"), "codes")
    known = written(coded.groupBy(F.col("_label").alias("_of")).agg(F.try_sum("_error").alias("_sum")), "label-errors")
    return coded.join(known, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_key").alias(key), F.col("_code").alias("code"), F.col("_error").alias("error"),
        F.col("_sum").alias("label_error"), F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
