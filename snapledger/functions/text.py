"""Text keys for search and display, all evaluated inside the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@functools.cache
def accent_table() -> tuple[str, str]:
    """Arguments for ``translate`` that strip accents.

    Built from the Unicode decomposition rule: a character whose canonical decomposition is one
    character plus combining marks maps to that character, and the marks themselves are deleted.
    """
    source, target, deleted = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Mc", "Me"):
            deleted.append(char)
            continue
        decomposed = unicodedata.normalize("NFD", char)
        if decomposed == char:
            continue
        base = "".join(c for c in decomposed if not unicodedata.category(c).startswith("M"))
        if len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source + deleted), "".join(target)


def search_key(column: Column | str) -> Column:
    """Lower-case, accent-free text; pure ASCII values (the common case) skip the translation."""
    value = F.col(column) if isinstance(column, str) else column
    lowered = F.lower(value)
    source, target = accent_table()
    return (F.when(F.octet_length(lowered) == F.char_length(lowered), lowered)
            .otherwise(F.translate(lowered, source, target)))


def search_key_of(word: str) -> str:
    """`search_key` for one search word on the driver."""
    source, target = accent_table()
    table = {ord(char): (target[i] if i < len(target) else None) for i, char in enumerate(source)}
    return word.lower().translate(table)


def add_search_key(df: DataFrame, columns: list[str], suffix: str = "_search") -> DataFrame:
    """Store the keys beside the data once, so that later searches are plain native scans."""
    if not columns:
        return df
    return df.withColumns({f"{name}{suffix}": search_key(name) for name in columns})


def display_text(column: Column | str, kind: str = "string") -> Column:
    """What a grid shows: every value as text, NULL as the empty string, and ``double`` as plain digits."""
    value = F.col(column) if isinstance(column, str) else column
    text = value.cast("string")
    if kind == "double":
        # Beyond what a decimal can hold the exponent stays.
        plain = F.regexp_replace(value.try_cast("decimal(38,16)").cast("string"), "(\\.[0-9]+?)0+$", "$1")
        text = F.when(text.contains("E"), F.coalesce(plain, text)).otherwise(text)
    return F.coalesce(text, F.lit(""))
