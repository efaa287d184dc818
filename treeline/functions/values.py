"""Report values as JSON text, driven by their types."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _quoted(text: Column) -> Column:
    """A string as JSON: what ``to_json`` makes of it within an array."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _joined(parts: Column, start: str, end: str) -> Column:
    return F.concat(F.lit(start), F.array_join(parts, ","), F.lit(end))


def json_value(value: Column, kind: T.DataType, sets: Collection[str] = (), path: str = "") -> Column:
    """JSON text of a value of any nesting; null becomes ``null``.

    Infinities become the texts ``"inf"`` and ``"-inf"``, at any depth; what is no
    number becomes null, as JSON cannot write it. Arrays whose dotted path is in
    ``sets`` stand for sets: sorted, each element once. Structs become objects with all
    their fields (a complex number is ``{real, imag}``), maps objects in order of their
    keys, binary values Base64, dates and times texts.
    """
    def below(name: str) -> str:
        return f"{path}.{name}" if path else name

    if isinstance(kind, T.StructType):
        fields = [
            F.concat(_quoted(F.lit(f.name)), F.lit(":"), json_value(value.getField(f.name), f.dataType, sets, below(f.name)))
            for f in kind.fields
        ]
        text = _joined(F.array(*fields), "{", "}") if fields else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        listed = F.array_sort(F.array_distinct(value)) if path in sets else value
        text = _joined(F.transform(listed, lambda x: json_value(x, kind.elementType, sets, path)), "[", "]")
    elif isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(
            e["key"].cast("string").alias("key"), json_value(e["value"], entry["value"].dataType, sets, path).alias("text")
        )))
        text = _joined(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["text"])), "{", "}")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(F.isnan(value), "null").when(value == float("inf"), '"inf"').when(value == float("-inf"), '"-inf"').otherwise(
            value.cast("string")
        )
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = _quoted(F.base64(value))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        text = _quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def json_rows(rows: DataFrame, sets: Collection[str] = ()) -> Column:
    """A row of ``rows`` as one JSON object."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in rows.columns])
    return json_value(row, rows.schema, sets)
