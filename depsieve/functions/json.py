"""JSON expressions with ECMAScript semantics."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_object(text: Column, fields: str) -> Column:
    """``text`` as a struct; NULL when it is not exactly one JSON object.

    Wrapping the text in an array makes the parser reject anything that follows the
    object. Maps keep the order of the text and any repeated keys.
    """
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"ARRAY<STRUCT<{fields}>>")
    return F.when(F.size(parsed) == 1, parsed[0])


def last_value(entries: Column, key: Column) -> Column:
    """The value of ``key`` in a parsed map, whose text may have named it more than once."""
    same = F.filter(F.map_entries(entries), lambda e: e["key"] == key)
    return F.try_element_at(same, F.lit(-1))["value"]


def unique_entries(entries: Column) -> Column:
    """A parsed map as (key, value) pairs: equal keys once, with the last value."""
    keys = F.map_keys(entries)
    distinct = F.array_distinct(keys)
    rebuilt = F.transform(distinct, lambda k: F.struct(k.alias("key"), last_value(entries, k).alias("value")))
    return F.when(F.size(distinct) == F.size(keys), F.map_entries(entries)).otherwise(rebuilt)


def truthy_text(value: Column) -> Column:
    """A JSON value as text if it is truthy, else NULL ('' , false, 0 and null)."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    falsy = (
        kind.isNull()
        | (kind == "VOID")
        | ((kind == "BOOLEAN") & (text == "false"))
        | ((kind == "STRING") & (text == ""))
        | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == 0))
    )
    return F.when(~falsy, text)
