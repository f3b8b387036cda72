"""Small things several of the text operators need."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.storage import materialized

_NAMES = count()


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: worked out once, safe from lost executors."""
    return materialized(df, f"llm-{label}")


def text_or_empty(column: str) -> Column:
    """A text column, quoted so that any name works, with null read as the empty text."""
    return F.coalesce(col(column).cast("string"), F.lit(""))


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once; named in a lambda, it would be for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{next(_NAMES)}"
    return name


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, whatever its size happens to be today."""
    return df.hint("merge")


def running_starts(counts: DataFrame, part: str, size: str) -> dict[int, int]:
    """Where each partition begins in a global numbering; one number per partition reaches the driver."""
    start, starts = 0, {}
    for row in counts.groupBy(part).agg(F.sum(size).alias(size)).orderBy(part).collect():
        starts[row[part]] = start
        start += row[size]
    return starts


def sorted_groups(batches, keys: list[str]):
    """Runs of rows with equal keys in batches that are sorted by them, as a dict of column arrays each.

    At most one batch and one group are held.
    """
    carry = None
    for batch in batches:
        if carry is not None:
            batch = pd.concat([carry, batch], ignore_index=True)
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        new = np.zeros(len(batch), dtype=bool)
        for key in keys:
            new[1:] |= columns[key][1:] != columns[key][:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for start, end in zip(starts, starts[1:], strict=False):
            yield {c: values[start:end] for c, values in columns.items()}
        carry = batch.iloc[starts[-1]:]
    if carry is not None:
        yield {c: carry[c].to_numpy() for c in carry.columns}
