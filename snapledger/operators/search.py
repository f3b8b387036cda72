"""Search over text columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.text import search_key, search_key_of


def search(df: DataFrame, word: str, columns: list[str] | None = None,
           key_suffix: str | None = None, mapping: dict | None = None) -> DataFrame:
    """Rows in which a column contains the word, ignoring case and accents.

    Without ``columns`` those that a declared mapping calls principal are searched, and without one all text
    columns. ``matched_columns`` tells which ones did. With ``key_suffix`` the keys stored beside the data
    are used (see `add_search_key`), and the search is a native scan of just those.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    principal = [name for name in (mapping or {}).get("principal_fields", []) if name in texts]
    names = columns or principal or texts
    if not names:
        raise ValueError("no text columns to search")
    needle = F.lit(search_key_of(word))
    hits = []
    for name in names:
        key = F.col(f"`{name}{key_suffix}`") if key_suffix else search_key(F.col(f"`{name}`"))
        hits.append(F.coalesce(F.contains(key, needle), F.lit(False)))
    flags = [f"__hit{i}" for i in range(len(names))]
    marked = df.withColumns(dict(zip(flags, hits)))
    matched = F.filter(F.array(*[F.when(F.col(flag), name) for flag, name in zip(flags, names)]),
                       lambda name: name.isNotNull())
    return (marked.where(functools.reduce(operator.or_, [F.col(flag) for flag in flags]))
            .withColumn("matched_columns", matched).drop(*flags))


def search_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows that match a LIKE pattern, handed over as a bound parameter."""
    return df.sparkSession.sql(
        "SELECT * FROM {rows} WHERE {column} LIKE :pattern", args={"pattern": pattern},
        rows=df, column=F.col(column))
