"""Packing of token sequences by linear grouping, configurations and best fit.

1. Every document becomes token ids and an end id. Longer ones are cut into pieces of the capacity.
2. Only the number of pieces of each length matters for the packing: at most ``capacity`` numbers,
   which the driver gets whatever the size of the corpus. Large lengths are sorted and dealt into
   groups of equal cardinality, each length rounded up to the longest of its group.
3. For these few sizes the best mix of configurations (which sizes share a sequence) is found by
   column generation: a linear program over configurations, new ones priced by a knapsack. Whole
   multiples of the configurations are used; what rounding leaves over is packed by best fit.
4. Actual pieces take the places of the rounded ones, and the small pieces go, longest first, to the
   fullest sequence that still has room for them.
5. Every piece finds its place by its length and its number among the pieces of that length. These
   numbers come from counts per partition and length, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from snapledger.llm.common import col, free_name, text_or_empty, written

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
#: Pieces longer than this part of the capacity count as large; they are dealt into so many groups.
LARGE, GROUPS = 1 / 8, 64
_ENCODERS: dict[str, object] = {}


class _Encoder:
    """Token ids of a text, as the ``tokenizers`` file gives them.

    The same vocabulary in rank form is about five times faster and gives the same ids (the tests
    compare them); texts that spell a special token or that it rejects go to ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        self.path, self.exact = public_tokenizers.path(f"{vocabulary}.json"), None

    def __call__(self, text: str) -> list[int]:
        if "<|" not in text:
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:
                pass
        if self.exact is None:
            from tokenizers import Tokenizer
            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids


def encoder(vocabulary: str = VOCABULARY) -> _Encoder:
    """The encoder of this Python worker, loaded once."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = _Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut(ids: list[int], capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter than the capacity."""
    first = len(ids) % capacity or min(len(ids), capacity)
    yield 0, first
    for start in range(first, len(ids), capacity):
        yield start, capacity


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used: the linear program's optimum, rounded down."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need, widths = np.array(demand, dtype=float), np.array(sizes)
    before = np.arange(capacity + 1)[None, :] - widths[:, None]
    fits, before = before >= 0, np.maximum(before, 0)
    for _ in range(50 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        # A knapsack, one more piece a turn, prices the most valuable new configuration.
        value, chosen = np.zeros(capacity + 1), []
        for _turn in range(capacity // min(sizes)):
            gain = np.where(fits, value[before] + duals[:, None], -np.inf)
            pick = gain.argmax(axis=0)
            best = gain[pick, np.arange(capacity + 1)]
            chosen.append(np.where(best > value, pick, -1))
            value = np.maximum(best, value)
        if value[capacity] <= 1 + 1e-6:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(chosen):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        direction, level = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        usable = direction > 1e-9
        ratio = np.where(usable, level / np.where(usable, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), int(level[j] + 1e-6)) for j in range(k) if level[j] >= 1 - 1e-6]


def _grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """The large lengths, longest first, in groups of equal cardinality: lists of (length, number)."""
    left = sum(counts.values())
    out, room = [], 0
    share = -(-left // groups) if left else 1
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


class _Open:
    """Sequences by the room they have left: room -> list of (number of sequences, lengths in them)."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)

    def add(self, number: int, lengths: tuple[int, ...]) -> None:
        if number:
            self.by_room[self.capacity - sum(lengths)].append((number, lengths))

    def best_fit(self, length: int, number: int) -> None:
        """Put so many pieces of a length where the least room stays, new sequences last."""
        while number:
            room = min((r for r, x in self.by_room.items() if r >= length and x), default=None)
            if room is None:
                room = self.capacity
                self.by_room[room].append((-(-number // (room // length)), ()))
            have, lengths = self.by_room[room].pop()
            each = room // length
            full = min(have, number // each)
            self.add(full, lengths + (length,) * each)
            number, have = number - full * each, have - full
            if have and 0 < number < each:
                self.add(1, lengths + (length,) * number)
                number, have = 0, have - 1
            self.add(have, lengths)


@dataclass(frozen=True)
class Plan:
    """Per length: first number of each run of pieces, and the sequence and offset where the run begins."""

    sequences: int
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, *, large: float = LARGE,
                 groups: int = GROUPS) -> Plan:
    """A packing of so many pieces of each length; needs only these numbers, not the pieces."""
    opened = _Open(capacity)
    opened.add(counts.get(capacity, 0), (capacity,))
    big = {s: n for s, n in counts.items() if large * capacity < s < capacity}
    parts = _grouped(big, groups)
    queues = [list(part) for part in parts]
    patterns = _configurations([part[0][0] for part in parts], [sum(n for _, n in part) for part in parts], capacity)
    for column, times in sorted(patterns, key=lambda p: -p[1]):
        slots = [i for i in range(len(parts)) for _ in range(column[i])]
        while times:
            # Every place takes actual pieces of its group; a run lasts while no length changes.
            wanted = Counter(slots)
            step = times
            for i, each in wanted.items():
                step = min(step, queues[i][-1][1] // each if queues[i] else 0)
            if step:
                opened.add(step, tuple(queues[i][-1][0] for i in slots))
                for i, each in wanted.items():
                    length, n = queues[i].pop()
                    if n - step * each:
                        queues[i].append((length, n - step * each))
                times -= step
                continue
            lengths = []
            for i in slots:
                if queues[i]:
                    length, n = queues[i].pop()
                    lengths.append(length)
                    if n > 1:
                        queues[i].append((length, n - 1))
            opened.add(1, tuple(lengths))
            times -= 1
            if not lengths:
                break
    rest = Counter({s: n for s, n in counts.items() if s <= large * capacity})
    for queue in queues:
        for length, n in queue:
            rest[length] += n
    for length in sorted(rest, reverse=True):
        opened.best_fit(length, rest[length])
    runs, taken, sequence = defaultdict(list), Counter(), 0
    for room in sorted(opened.by_room):
        for number, lengths in opened.by_room[room]:
            if not lengths:
                continue
            offset = 0
            for length in lengths:
                runs[length].append((taken[length], sequence, offset))
                taken[length] += number
                offset += length
            sequence += number
    return Plan(sequence, {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()})


def pieces(df: DataFrame, text: str, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
           end_id: int = END_ID) -> DataFrame:
    """The other columns with ``piece``, ``start``, ``length``, ``ids_crc32`` and a number within task and length.

    Whole texts are tokenised; ids are not kept beyond their checksum.
    """
    others = [f for f in df.schema.fields if f.name != text]
    rows = df.select(F.struct(*[col(f.name) for f in others]).alias("_row") if others else F.lit(None).alias("_row"),
                     text_or_empty(text).alias("_text"))
    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,_task:int,_number:bigint>>"

    @F.pandas_udf(kind)
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for value in batch:
                ids = encode(value)
                ids.append(end_id)
                data, found = memoryview(array("I", ids).tobytes()), []
                for i, (start, length) in enumerate(cut(ids, capacity)):
                    found.append({"piece": i, "start": start, "length": length, "_task": task, "_number": seen[length],
                                  "ids_crc32": zlib.crc32(data[4 * start:4 * (start + length)])})
                    seen[length] += 1
                out.append(found)
            yield pd.Series(out)

    return (rows.select("_row", F.explode(cut_up("_text")).alias("_piece"))
            .select(*[F.col("_row")[f.name].alias(f.name) for f in others], "_piece.*"))


def pack(df: DataFrame, text: str = "text", *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
         end_id: int = END_ID, large: float = LARGE, groups: int = GROUPS) -> DataFrame:
    """A row per piece: the other columns, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null text: empty, so only the end id. Repeated rows are packed as often as they occur. Columns of
    the result's names in the input are replaced. An empty table gives an empty result.
    """
    made = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_task", "_number")
    kept = df.select(*[col(c) for c in df.columns if c == text or c not in made])
    found = written(pieces(kept, text, capacity=capacity, vocabulary=vocabulary, end_id=end_id), "pieces")
    sizes = written(found.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = df.sparkSession.sparkContext.broadcast(plan_packing(totals, capacity, large=large, groups=groups).runs)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = found.join(firsts, ["_task", "length"])

    @F.pandas_udf(StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        length, number = lengths.to_numpy(), numbers.to_numpy()
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            first, begin, at = plan.value[int(length[rows[0]])]
            run = np.searchsorted(first, number[rows], side="right") - 1
            sequence[rows] = begin[run] + number[rows] - first[run]
            offset[rows] = at[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = free_name(numbered, "_place")
    return (numbered.withColumn(at, place("length", F.col("_number") + F.col("_first")))
            .select(*[col(c) for c in kept.columns if c != text], F.col("piece").cast(IntegerType()), "start",
                    "length", "ids_crc32", F.col(at)["sequence_id"].alias("sequence_id"),
                    F.col(at)["offset"].alias("offset")))
