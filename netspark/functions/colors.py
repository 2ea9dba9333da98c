"""Colours as Column expressions over texts #RRGGBB; parts between whole numbers are cut off.

Null stays null. A text that is no such colour has no parts: `with_alpha` leaves it
as it is, `brighten` and `ramp` give null, and text upon it is black.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wong's colours, which colour-blind readers tell apart.
COLORBLIND = ["#000000", "#E69F00", "#56B4E9", "#009E73", "#F0E442", "#0072B2", "#D55E00", "#CC79A7"]


def parts(color: Column) -> list[Column]:
    """Red, green and blue from 0 to 255; null for other texts."""
    known = F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), color)
    return [F.conv(F.substring(known, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]


def to_hex(*values: Column) -> Column:
    whole = [F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(255)).cast("long") for v in values]
    return F.when(sum(values, F.lit(0)).isNotNull(), F.concat(F.lit("#"), *[F.lpad(F.hex(v), 2, "0") for v in whole]))


def with_alpha(color: Column, alpha: float = 1.0) -> Column:
    """The colour with two more digits for its opacity."""
    return F.coalesce(to_hex(*parts(color), F.lit(round(alpha * 255))), color)


def brighten(color: Column, amount: float = 0.2) -> Column:
    """Every part so much of the way to white, or to black where the amount is negative."""
    return to_hex(*[p + (255 - p) * amount if amount > 0 else p * (1 + amount) for p in parts(color)])


def text_on(color: Column) -> Column:
    """Black on light colours, white on dark ones."""
    red, green, blue = parts(color)
    return F.when((0.299 * red + 0.587 * green + 0.114 * blue) / 255 <= 0.5, "white").otherwise("black")


def ramp(share: Column, colors: list[str]) -> Column:
    """The colour at a share from 0 to 1 of the way through colours that stand at equal distances."""
    share = F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))) * (len(colors) - 1)
    step = F.least(F.floor(share), F.lit(max(len(colors) - 2, 0))).cast("int")
    stops = F.array(*[F.array(*[F.lit(int(c[i : i + 2], 16)).cast("double") for i in (1, 3, 5)]) for c in colors])
    if len(colors) == 1:
        return F.when(share.isNotNull(), colors[0])
    here, there = F.get(stops, step), F.get(stops, step + 1)
    return to_hex(*[F.get(here, F.lit(i)) + (F.get(there, F.lit(i)) - F.get(here, F.lit(i))) * (share - step) for i in range(3)])


def scale_color(df: DataFrame, value: str, colors: list[str], name: str = "color", limits: tuple[float, float] | None = None) -> DataFrame:
    """df with a colour of each value between the limits (the least and the largest value); without spread or value: null, without any value at all: gray50."""
    span = df.agg(F.min(value).alias("__low"), F.max(value).alias("__high")) if limits is None else df.sparkSession.range(1).select(F.lit(float(limits[0])).alias("__low"), F.lit(float(limits[1])).alias("__high"))
    share = F.try_divide(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low"))
    return df.join(F.broadcast(span), how="cross").withColumn(name, F.when(F.col("__low").isNull(), "gray50").otherwise(ramp(share, colors))).drop("__low", "__high")


def color_levels(df: DataFrame, level: str, palette: list[str] | None = None, name: str = "color") -> DataFrame:
    """df with a colour of each level, in the levels' order; null has none.

    A palette starts again where it ends; without one, Wong's colours, and a ramp through them for more levels.
    """
    found = df.select(F.col(level).alias("__level")).filter("__level is not null").distinct()
    placed = found.withColumn("__i", F.row_number().over(Window.orderBy("__level")) - 1).withColumn("__n", F.count("*").over(Window.partitionBy()))
    colors = palette or COLORBLIND
    each = F.get(F.array(*[F.lit(c) for c in colors]), (F.col("__i") % len(colors)).cast("int"))
    if palette is None:
        each = F.when(F.col("__n") <= len(colors), each).otherwise(ramp(F.try_divide("__i", F.col("__n") - 1), colors))
    return df.join(placed.select("__level", each.alias(name)), F.col(level) == F.col("__level"), "left").drop("__level")
