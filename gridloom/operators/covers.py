"""Land-cover classes: histograms per cell, fractions, class tables, dominant classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import DESERT, LAKE, SEA

CLASSES = 256


def checked(cover: Column, most: int = CLASSES) -> Column:
    """The class, or an error if it is not within 1 to most; nulls pass."""
    return F.when(cover.isNull() | cover.between(1, most), cover).otherwise(F.raise_error(F.concat(F.lit("class out of range: "), cover.cast("string"))))


def fractions(mapped: DataFrame, cover: str = "cover", key: str = "iglo2", most: int = CLASSES) -> DataFrame:
    """AG-COVER in long form: key, cover, n and frac, the share of the cell's points; one shuffle of a row per cell, class and task.

    A point without a class counts towards no fraction."""
    n = mapped.where(F.col(cover).isNotNull()).groupBy(key, checked(F.col(cover), most).alias("cover")).agg(F.count("*").alias("n"))
    cells = n.groupBy(key).agg(F.sum("n").alias("_all"))
    return n.join(cells, key).select(key, "cover", "n", (F.col("n") / F.col("_all")).alias("frac"))


def wide(mapped: DataFrame, cover: str = "cover", key: str = "iglo2", most: int = CLASSES) -> DataFrame:
    """AG-COVER in wide form: cover001 and so on, for writing."""
    named = mapped.withColumn("_c", checked(F.col(cover), most))
    counts = named.groupBy(key).pivot("_c", list(range(1, most + 1))).count()
    columns = [F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in range(1, most + 1)]
    total = F.aggregate(F.array(*columns), F.lit(0).cast("long"), lambda s, x: s + x)
    return counts.withColumn("_n", total).select(key, *[(c / F.when(F.col("_n") > 0, F.col("_n"))).alias(f"cover{k:03d}") for k, c in enumerate(columns, 1)])


def nonempty(fractions: DataFrame, n_cells: int | None = None) -> DataFrame:
    """AG-NONEMPTY: the classes whose mean share is over 0."""
    return fractions.groupBy("cover").agg(F.sum("frac").alias("total")).where("total > 0").select("cover")


def parameter_means(fractions: DataFrame, table: DataFrame, names: list[str], key: str = "iglo2") -> DataFrame:
    """JN-CLASS: mean of each class parameter over the classes of a cell, by share; null where their shares add up to 0. The class table has some hundred rows."""
    joined = fractions.join(F.broadcast(table), "cover")
    share = F.col("frac")
    return joined.groupBy(key).agg(*[F.try_divide(F.sum(share * F.col(p)), F.sum(share)).alias(p) for p in names])


#: Fixed value: the vegetation type of rock.
ROCK = 2


def resolved(table: DataFrame, garden: bool = True, water: bool = True, town: bool = True) -> DataFrame:
    """PRJ-RESOL: shares of a class that are not to be resolved move: water mixed with land to nature, town to nature as rock, gardens of towns to nature.

    Where the table has types (an array of structs with type and share), a town adds its share to rock."""
    nature, sealed, moved = F.col("nature"), F.col("town"), {}
    has_garden = "garden" in table.columns
    green = F.coalesce("garden", F.lit(0.0)) if has_garden else F.lit(0.0)
    if has_garden and (garden or not town):
        nature, sealed = nature + green * F.col("town"), F.col("town") * (1 - green)
        moved |= {"town": sealed, "garden": F.lit(0.0)}
    if not water:
        mixed = (F.col("water") > 0) & (F.col("water") < 1)
        nature, moved["water"] = F.when(mixed, nature + F.col("water")).otherwise(nature), F.when(mixed, 0.0).otherwise(F.col("water"))
    if not town:
        if "types" in table.columns:
            built = (F.col("town") > 0) | (green > 0)
            whole = nature + sealed
            known = F.coalesce("types", F.array().cast(table.schema["types"].dataType))
            shared = F.transform(known, lambda x: x.withField("share", x["share"] * nature / whole + F.when(x["type"] == ROCK, sealed / whole).otherwise(0.0)))
            fields = table.schema["types"].dataType.elementType
            rock = F.struct(*[(F.lit(ROCK).cast(f.dataType) if f.name == "type" else sealed / whole if f.name == "share" else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
            moved["types"] = F.when(built, F.when(F.exists(known, lambda x: x["type"] == ROCK), shared).otherwise(F.concat(shared, F.array(rock)))).otherwise(F.col("types"))
        nature, moved["town"] = nature + sealed, F.lit(0.0)
    return table.withColumns({**moved, "nature": nature})


def top_two(shares: list[Column]) -> tuple[Column, Column]:
    """TOP-2: numbers, from 1 on, of the largest and second share over 0, the first of equal ones; 0 where there is none."""
    each = F.array(*[F.struct((-F.coalesce(s, F.lit(0.0))).alias("minus"), F.lit(k).alias("k")) for k, s in enumerate(shares, 1)])
    order = F.filter(F.array_sort(each), lambda x: x["minus"] < 0)
    return tuple(F.coalesce(F.get(order, m)["k"], F.lit(0)) for m in (0, 1))


def dominant(shares: list[Column], land: Column, sea: int = SEA, desert: int = DESERT, lake: int = LAKE) -> Column:
    """PRJ-DOMVEG: the dominant class; off land the sea unless it is the lake, on land the second class (or desert) instead of sea or lake."""
    first, second = top_two(shares)
    wet = (first == sea) | (first == lake)
    off = F.when(first == lake, first).otherwise(F.lit(sea))
    on = F.when(wet, F.when(second == 0, F.lit(desert)).otherwise(second)).otherwise(first)
    return F.when(land >= 0.5, on).otherwise(off)


def one_hot(kind: Column, n: int = 5) -> list[Column]:
    """PRJ-ONEHOT: n columns of 0 and 1; an error for classes outside 1 to n."""
    return [(checked(kind, n) == k).cast("double") for k in range(1, n + 1)]
