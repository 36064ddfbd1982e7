"""Line tables from any text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character that ends a line; a carriage return directly before a newline belongs to it.
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029]"


def _without_last_empty(parts: Column) -> Column:
    last = F.size(parts) - 1
    return F.when(F.get(parts, last) == "", F.slice(parts, F.lit(1), last)).otherwise(parts)


def text_lines(text: Column) -> Column:
    """The lines of a text as an array, without the empty string after a final line break."""
    # A one-element transform binds the split text to a name, so that it is split only once.
    bound = F.transform(F.array(F.split(text, LINE_BREAK, -1)), lambda parts: _without_last_empty(parts))
    return F.get(bound, F.lit(0))


def explode_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line, numbered from 1. Empty and null texts have no lines."""
    split = df.select(*keys, F.split(F.col(text), LINE_BREAK, -1).alias("parts"))
    return split.select(*keys, F.posexplode(_without_last_empty(F.col("parts"))).alias("at", "line")).select(
        *keys, (F.col("at") + 1).alias("line_number"), "line"
    )


def text_source(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Any table as scan input: its key columns and the text under the name ``content``."""
    return df.select(*keys, F.col(text).alias("content"))
