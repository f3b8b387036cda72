"""Rows that every operator has to take: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000)) + "\n" + "x" * 50_000
ROWS = [(1, None), (2, ""), (3, "one two three four five six seven."), (3, "one two three four five six seven."),
        (4, "one two three four five six seven."), (None, "no key, but a text"), (None, None), (5, LONG), (6, LONG + " end"),
        (7, " \n\t\n "), (8, "12345 67890 !!"), (9, "é" * 30 + "\nñandú\r\n"), (10, None)]
CLASHES = ["_text", "_key", "_hash", "_row", "_piece", "_document", "_runs", "removed", "lang_pred", "score", "spans", "piece",
           "class_id", "slot", "shard", "_page", "_found", "key", "item", "sequence_id", "dotted.name"]


def frame(spark, rows=None, columns=("doc_id", "text"), types=("bigint", "string")):
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True))
    df = spark.createDataFrame(ROWS if rows is None else rows, schema)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in columns])
