"""JSON text of nested values against Python's own encoder."""

import json
import math
import random

from pyspark.sql import functions as F

from treeline.functions import values

SCHEMA = (
    "n bigint, x double, t string, b boolean, d decimal(6,2), z struct<real:double,imag:double>, a array<array<double>>, "
    "m map<string,array<double>>, s array<string>, deep struct<s:array<bigint>,e:array<struct<v:float>>>, day date, bin binary"
)


def plain(value, path="", sets=("s", "deep.s")):
    """What the text should read back as."""
    if isinstance(value, float):
        return None if math.isnan(value) else str(value) if math.isinf(value) else value
    if isinstance(value, list):
        if path in sets:
            value = sorted(set(v for v in value if v is not None)) + [None] * (None in value)
        return [plain(v, path, sets) for v in value]
    if isinstance(value, dict):
        return {k: plain(v, f"{path}.{k}" if path else k, sets) for k, v in value.items()}
    return value


def test_equals_pythons_encoder(spark):
    pick = random.Random(4)

    def number():
        return pick.choice([0.5, -3.0, 1e300, float("inf"), float("-inf"), float("nan"), None])

    rows = []
    for i in range(60):
        rows.append({
            "n": pick.choice([None, i]), "x": number(), "t": pick.choice([None, "", 'q"\\\n\té 😀\x01']), "b": pick.choice([True, False, None]),
            "d": None, "z": pick.choice([None, {"real": number(), "imag": number()}]),
            "a": pick.choice([None, [], [[], [number(), number()], None]]),
            "m": pick.choice([None, {}, {'k"': [number()], "b": None, "a": []}]), "s": pick.choice([None, [], ["b", "a", "b", "é"]]),
            "deep": {"s": [3, 1, 3], "e": [{"v": pick.choice([0.5, -3.0, None]) if i % 2 else float("inf")}, None]}, "day": None, "bin": None,
        })
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select(values.json_rows(df, {"s", "deep.s"}).alias("j")).collect()
    for row, text in zip(rows, got):
        expected = plain(row)
        read = json.loads(text.j)
        assert read == expected


def test_keys_are_sorted_and_plain_kinds(spark):
    df = spark.range(1).select(
        F.create_map(F.lit(10), F.lit(1.5), F.lit(9), F.lit(float("inf"))).alias("m"), F.lit(None).alias("v"),
        F.lit("12.50").cast("decimal(6,2)").alias("d"), F.lit("2024-01-02").cast("date").alias("day"), F.lit(b"\x00\xff").alias("bin"), F.struct().alias("e"),
    )
    assert df.select(values.json_rows(df)).first()[0] == (
        '{"m":{"10":1.5,"9":"inf"},"v":null,"d":12.50,"day":"2024-01-02","bin":"AP8=","e":{}}'
    )
