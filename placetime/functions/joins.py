"""Joins against a smaller table: broadcast when its measured rows and bytes allow it, a plain
equality join otherwise, whose hot keys adaptive execution splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20        # as text, which is larger than what is sent


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when df has at most `rows` rows of at most `size` bytes as text; stops right after the row bound."""
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return n <= rows and total <= size


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows: int = BROADCAST_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """Join `big` to a dimension `small` on equal columns.

    Measuring `small` evaluates it once more, so this is for sides that are cheap to build
    (polygons, stops, presets); two derived sides are joined plainly and left to adaptive
    execution.  A side within the bounds is broadcast; beyond them both sides meet on `on` alone,
    whatever the columns' types, and a hot key's rows are split from the shuffle's map outputs.
    `fits` passes in the answer when the caller has measured the side more cheaply.
    """
    on = list(on)
    if is_small(small, rows) if fits is None else fits:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def spread_out(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hash partitions on `on` that adaptive execution does not merge: for sides of few bytes whose join or explode
    makes many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def literal_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A handful of parameter rows (presets, windows, rules) as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def param_array(rows: Sequence[dict]) -> Column:
    """Parameter rows as an array-of-structs literal, to be exploded beside data rows."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])
