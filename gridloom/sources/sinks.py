"""Writers of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .writers import write_batches, write_record

__all__ = ["write_batches", "write_record"]


def write_months(df: DataFrame, path: str, month: str = "month") -> None:
    """SNK-MONTH: a folder for each month; months without values are not there."""
    df.write.mode("overwrite").partitionBy(month).parquet(path)


def write_month_fields(df: DataFrame, path: str, fields: list[str], month: str = "month", key: str = "iglo") -> None:
    """SNK-MONTH in long form: a folder for each month and field; fields that a month has no value of are not there."""
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]), lambda x: x["value"].isNotNull()))
    df.select(month, key, each.alias("x")).select(month, key, "x.*").write.mode("overwrite").partitionBy(month, "field").parquet(path)


def with_sentinel(df: DataFrame, fields: list[str], undef: float) -> DataFrame:
    """Nulls as the sentinel of a format that has no other way."""
    return df.fillna(undef, fields)


def flipped(df: DataFrame, ny: int, j: str = "j") -> DataFrame:
    """SNK-FA: rows from the other end."""
    return df.withColumn(j, F.lit(ny - 1) - F.col(j))


def discard(df: DataFrame) -> None:
    """SNK-NULL, SNK-NC: computes everything and writes nothing."""
    df.write.format("noop").mode("overwrite").save()


def keep_point(held: DataFrame | None, df: DataFrame, source: int, place: int, key: str = "iglo") -> DataFrame:
    """SNK-POINT: the row of one point, under another key, added to what is held."""
    one = df.where(F.col(key) == source).withColumn(key, F.lit(place).cast("long"))
    return one if held is None else held.where(F.col(key) != place).unionByName(one, allowMissingColumns=True)
