import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from snapledger.functions.naming import (date_text_compat, sanitize_columns, sanitize_name, sanitize_text,
                                         snapshot_date, snapshot_table_name, unique_names)
from snapledger.functions.text import display_text, search_key, search_key_of
from snapledger.functions.types import infer_text_types, spark_type, type_profile, wider_type


def values(spark, items, expression):
    rows = [(i, item) for i, item in enumerate(items)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression.alias("x")).collect()]


# Names of dumps and the dates they carry, worked out by hand: leniently, and in strict mode.
DATED = [
    ("dump_20_11_2013.bak", "2013-11-20", "2013-11-20"), ("db 2024-01-15.bak", "2024-01-15", "2024-01-15"),
    ("x15012024.bak", "2024-01-15", None), ("x20240115.bak", "2024-01-15", None), ("a_32_13_2020.bak", None, None),
    ("a_32_13_2020_x_2021-02-03.bak", "2021-02-03", "2021-02-03"), ("m_20-11_2013.bak", "2013-11-20", None),
    ("none.bak", None, None), ("z_01_01_0000.bak", None, None), ("", None, None), (None, None, None),
    ("12_12_2012_and_2013_01_01", "2012-12-12", "2012-12-12"), ("v1234567.bak", None, None), ("2023_02_30", None, None),
    ("30_02_2023 2024_02_29", "2024-02-29", "2024-02-29"), ("dump_20101231", "2010-12-31", None), ("a_20111210", "2011-12-10", None),
    ("b_10122011", "2011-12-10", None), ("c_01_02_1850", None, "1850-02-01"),
]
NAMES = [name for name, _, _ in DATED]


def test_dates_in_names(spark):
    day = lambda text: text and datetime.date.fromisoformat(text)
    assert values(spark, NAMES, snapshot_date("v")) == [day(d) for _, d, _ in DATED]
    assert values(spark, NAMES, snapshot_date("v", "strict")) == [day(d) for _, _, d in DATED]
    old = snapshot_date("v", years=(1800, 2100))
    assert values(spark, ["c_01_02_1850"], old) == [datetime.date(1850, 2, 1)]


def test_compat_text_takes_the_first_hit_unchecked(spark):
    texts = dict(zip(NAMES, values(spark, NAMES, date_text_compat("v"))))
    assert texts["x20240115.bak"] == "0115-24-20"
    assert texts["a_32_13_2020.bak"] == "2020-13-32"
    assert texts["none.bak"] is None
    dates = dict(zip(NAMES, values(spark, NAMES, snapshot_date("v", "compat", default="1999-09-09"))))
    assert dates["a_32_13_2020.bak"] is None
    assert dates["none.bak"] == datetime.date(1999, 9, 9)


def test_date_precedence(spark):
    day = datetime.date(2001, 2, 3)
    assert set(values(spark, NAMES, snapshot_date("v", override="2001-02-03"))) == {day}
    found = dict(zip(NAMES, values(spark, NAMES, snapshot_date("v", default="2001-02-03"))))
    assert found["none.bak"] == day and found["dump_20_11_2013.bak"] == datetime.date(2013, 11, 20)


def test_sanitised_names(spark):
    names = ["Order Details", "2023 sales", "é-x", "a.b/c", "_ok", "", "😀1"]
    expected = ["Order_Details", "T_2023_sales", "__x", "a_b_c", "_ok", "", "_1"]
    assert values(spark, names, sanitize_name("v")) == expected
    assert [sanitize_text(n) for n in names] == expected
    day = F.lit("2013-11-20").cast("date")
    assert values(spark, ["t"], snapshot_table_name("v", day)) == ["t_20131120"]


def test_column_names_that_meet_stay_apart(spark):
    assert unique_names(["a b", "a-b", "A_B", "a_b_2"]) == ["a_b", "a_b_3", "A_B_4", "a_b_2"]
    df, changed = sanitize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))
    assert df.columns == ["a_b", "a_b_2"] and changed == {"a_b": "a b", "a_b_2": "a-b"}


def stripped(text):
    decomposed = unicodedata.normalize("NFD", text.lower())
    return unicodedata.normalize("NFC", "".join(
        c for c in decomposed if not unicodedata.category(c).startswith("M")))


def test_search_key_equals_unicode_decomposition(spark):
    letters = [chr(c) for c in range(0x20, 0x2000) if unicodedata.category(chr(c))[0] in "LMN"]
    # Letters Java and Python lower-case differently (by Unicode version) are left out.
    words = [f"x{c}y" for c in letters if len(c.lower()) == 1]
    lowered = values(spark, words, F.lower("v"))
    words = [w for w, low in zip(words, lowered) if low == w.lower()]
    assert len(words) > 4000
    assert values(spark, words, search_key("v")) == [stripped(w) for w in words]
    assert [search_key_of(w) for w in words] == [stripped(w) for w in words]


def test_search_key_of_composed_and_ascii_text(spark):
    words = ["ÉTION", "Étion", "Plain ASCII", "straße", "œuvre", None]
    assert values(spark, words, search_key("v")) == ["etion", "etion", "plain ascii", "straße", "œuvre", None]


def test_display_text(spark):
    assert values(spark, ["a", None], display_text("v")) == ["a", ""]
    plain = display_text(F.col("v").cast("double"), "double")
    assert values(spark, ["12345678.9", "1e7", "0.0001", "2.5", "1e30", None], plain) == ["12345678.9", "10000000.0", "0.0001", "2.5", "1.0E30", ""]


def test_type_ladder(spark):
    columns = {
        "b": (["true", "FALSE", None], "boolean"), "i": (["1", "-20", "7"], "bigint"),
        "big": (["1", "9223372036854775807", "9223372036854775808"], "string"),
        "long": (["1", "9223372036854775807", "-9223372036854775808"], "bigint"), "zeros": (["00123", "7", None], "string"),
        "mixed": (["1.5", "12345678901234567", None], "string"),
        "d": (["1", "2.5", "-1e3"], "double"), "day": (["2024-01-31", None, "1999-12-01"], "date"),
        "t": (["2024-01-31", "2024-01-31 10:20:30.5", None], "timestamp_ntz"),
        "bad": (["2024-02-30", None, None], "string"), "year": (["2020", "2021", None], "bigint"),
        "odd": (["1d", "NaN", "Infinity"], "string"), "none": ([None, None, None], "string"),
        "mix": (["1", "2024-01-01", None], "string"), "text": (["t", "f", "yes"], "string")}
    rows = list(zip(*[v for v, _ in columns.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    expected = {c: kind for c, (_, kind) in columns.items()}
    assert infer_text_types(df) == expected
    profile = {r["column_name"]: r for r in type_profile(df).collect()}
    assert {c: r["inferred_type"] for c, r in profile.items()} == expected
    assert profile["big"]["n_bigint"] == 2 and profile["big"]["n_double"] == 1
    assert profile["mix"]["n_values"] == 2 and profile["mix"]["n_date"] == 1


def test_wider_types():
    assert wider_type("int", "bigint") == "bigint"
    # 2**53 + 1 is no double, so only text holds both.
    assert wider_type("bigint", "double") == "string" == wider_type("float", "bigint")
    assert wider_type("int", "double") == "double" == wider_type("float", "int")
    assert wider_type("date", "timestamp_ntz") == "timestamp_ntz"
    assert wider_type("bigint", "string") == "string"
    assert wider_type("boolean", "bigint") == "string"
    assert wider_type("decimal(10,2)", "decimal(12,4)") == "decimal(12,4)"
    assert wider_type("int", "decimal(5,2)") == "decimal(12,2)"
    assert wider_type("timestamp", "date") == "timestamp"
    for pair in (("decimal(38,2)", "decimal(38,4)"), ("double", "decimal(5,2)")):
        with pytest.raises(ValueError, match="without loss"):
            wider_type(*pair)


def test_declared_text_types_have_lengths():
    assert {spark_type(x) for x in ("VARCHAR(20)", "char(3)", "TEXT", "nvarchar( 5 )", "CHAR")} == {"string"}
    assert spark_type("DECIMAL(10,2)") == "decimal(10,2)"
