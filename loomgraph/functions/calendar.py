"""Solar and lunar calendar: day numbers, new moons, month numbers and cyclic names.

The lunar calendar is built set-wise: new moons and solar sectors of a span of years form a month table, from which months are numbered by windows and days by a range lookup.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cyclic names (fixed values).
STEMS = ("Giáp", "Ất", "Bính", "Đinh", "Mậu", "Kỷ", "Canh", "Tân", "Nhâm", "Quý")
BRANCHES = ("Tý", "Sửu", "Dần", "Mão", "Thìn", "Tỵ", "Ngọ", "Mùi", "Thân", "Dậu", "Tuất", "Hợi")
_RAD = math.pi / 180
#: Periodic terms of the new moon: amplitude, change per century, multiples of the sun's and moon's anomalies and of the latitude argument (fixed values).
MOON_TERMS = ((0.1734, -0.000393, 1, 0, 0), (0.0021, 0, 2, 0, 0), (-0.4068, 0, 0, 1, 0), (0.0161, 0, 0, 2, 0), (-0.0004, 0, 0, 3, 0), (0.0104, 0, 0, 0, 2), (-0.0051, 0, 1, 1, 0), (-0.0074, 0, 1, -1, 0), (0.0004, 0, 1, 0, 2), (-0.0004, 0, -1, 0, 2), (-0.0006, 0, 0, 1, 2), (0.0010, 0, 0, -1, 2), (0.0005, 0, 1, 2, 0))


def day_number(d: Column) -> Column:
    """Julian day number of a date."""
    return F.unix_date(d) + 2440588


def date_of(jd: Column) -> Column:
    return F.date_from_unix_date((jd - 2440588).cast("int"))


def _poly(t: Column, *c: float) -> Column:
    out = F.lit(float(c[-1]))
    for x in reversed(c[:-1]):
        out = out * t + float(x)
    return out


def new_moon(k: Column) -> Column:
    """Julian date of the k-th new moon."""
    t = k / 1236.85
    k = k.cast("double")
    mean = 2415020.75933 + 29.53058868 * k + _poly(t, 0, 0, 0.0001178, -0.000000155) + 0.00033 * F.sin(_poly(t, 166.56, 132.87, -0.009173) * _RAD)
    sun = 359.2242 + 29.10535608 * k + _poly(t, 0, 0, -0.0000333, -0.00000347)
    moon = 306.0253 + 385.81691806 * k + _poly(t, 0, 0, 0.0107306, 0.00001236)
    lat = 21.2964 + 390.67050646 * k + _poly(t, 0, 0, -0.0016528, -0.00000239)
    wave = F.lit(0.0)
    for a, change, s, m, f in MOON_TERMS:
        amp = a + change * t if change else F.lit(float(a))
        wave = wave + amp * F.sin((s * sun + m * moon + f * lat) * _RAD)
    early = _poly(t, 0.001, 0.000839, 0.0002261, -0.00000845, -0.000000081)
    return mean + wave - F.when(t < -11, early).otherwise(_poly(t, -0.000278, 0.000265, 0.000262))


def sun_longitude(jd: Column) -> Column:
    """Apparent longitude of the sun in radians, in [0, 2 pi)."""
    t = (jd - 2451545.0) / 36525.0
    m = _poly(t, 357.5291, 35999.0503, -0.0001559, -0.00000048) * _RAD
    lon = _poly(t, 280.46646, 36000.76983, 0.0003032) + _poly(t, 1.9146, -0.004817, -0.000014) * F.sin(m) + 0.019993 * F.sin(2 * m) - 0.00569 - 0.00478 * F.sin((125.04 - 1934.136 * t) * _RAD)
    lon = lon * _RAD
    return lon - 2 * math.pi * F.floor(lon / (2 * math.pi))


def moon_day(k: Column, zone: float = 7.0) -> Column:
    return (new_moon(k) + 0.5 + zone / 24).cast("bigint")


def sector(day: Column, zone: float = 7.0) -> Column:
    """Twelfth of the sun's path at the start of a day."""
    return (sun_longitude(day - 0.5 - zone / 24) / (math.pi / 6)).cast("int")


def months(spark: SparkSession, first_year: int, last_year: int, zone: float = 7.0) -> DataFrame:
    """(start, next_start, lunar_month, lunar_year, leap) of all lunar months that touch the years. A table of 12.4 rows a year.

    Month 11 holds the winter solstice (the last month start before sector 9 begins). A lunar year from one month 11 to the next with thirteen months has a leap month: the first whose start lies in the same sector as the next month's start.
    """
    k0, k1 = int((first_year - 1900) * 12.3685) - 30, int((last_year - 1900) * 12.3685) + 45
    m = spark.range(k0, k1).select(F.col("id").alias("k"), moon_day(F.col("id"), zone).alias("start")).withColumn("sec", sector(F.col("start"), zone))
    w = W.partitionBy().orderBy("k")  # one row per month of the span
    m = m.withColumn("next_start", F.lead("start").over(w)).withColumn("next_sec", F.lead("sec").over(w))
    year_of = F.year(date_of(F.col("start")))
    m = m.withColumn("eleven", (F.col("sec") < 9) & (F.col("next_sec") >= 9) & (F.col("sec") >= 6)).withColumn("cycle", F.sum(F.col("eleven").cast("int")).over(w))
    c = W.partitionBy("cycle").orderBy("k")
    m = m.withColumn("n", F.count("*").over(W.partitionBy("cycle"))).withColumn("i", F.row_number().over(c) - 1)
    same = (F.col("n") == 13) & (F.col("sec") == F.col("next_sec")) & (F.col("i") > 0)
    m = m.withColumn("leap_at", F.min(F.when(same, F.col("i"))).over(W.partitionBy("cycle")))
    after = F.coalesce((F.col("i") >= F.col("leap_at")).cast("int"), F.lit(0))
    number = F.pmod(F.col("i") - after + 10, F.lit(12)) + 1
    solstice_year = F.first(year_of).over(c)
    # months 11 and 12 belong to the year of the solstice, the others to the next
    late = (F.col("i") - after) >= 2
    return m.where("cycle > 0 and next_start is not null").select("start", "next_start", number.cast("int").alias("lunar_month"), (solstice_year + late.cast("int")).cast("int").alias("lunar_year"), F.coalesce(F.col("i") == F.col("leap_at"), F.lit(False)).alias("leap"))


def cyclic(n: Column, shift_stem: int, shift_branch: int) -> Column:
    stem = F.element_at(F.array(*[F.lit(x) for x in STEMS]), (F.pmod(n + shift_stem, F.lit(10)) + 1).cast("int"))
    branch = F.element_at(F.array(*[F.lit(x) for x in BRANCHES]), (F.pmod(n + shift_branch, F.lit(12)) + 1).cast("int"))
    return F.concat_ws(" ", stem, branch)


def year_name(lunar_year: Column) -> Column:
    return cyclic(lunar_year, 6, 8)


def day_name(jd: Column) -> Column:
    return cyclic(jd, 9, 1)


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per day with the ten columns of the calendar table. Each month is exploded to its days, so no range join is needed."""
    m = months(spark, first_year, last_year)
    days = m.select("*", F.explode(F.sequence(F.col("start"), F.col("next_start") - 1)).alias("jd"))
    d = date_of(F.col("jd"))
    out = days.withColumn("solar_date", d).where(F.year("solar_date").between(first_year, last_year))
    return out.select(
        "solar_date", F.day("solar_date").alias("solar_day"), F.month("solar_date").alias("solar_month"), F.year("solar_date").alias("solar_year"), (F.col("jd") - F.col("start") + 1).cast("int").alias("lunar_day"), "lunar_month", "lunar_year",
        F.col("leap").cast("int").alias("is_leap_month"), year_name(F.col("lunar_year")).alias("can_chi_year"), day_name(F.col("jd")).alias("can_chi_day"),
    )


def lunar_to_solar(asked: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """asked(lunar_day, lunar_month, lunar_year, is_leap_month) with solar_date; null for days and leap months that do not exist."""
    c = calendar(asked.sparkSession, first_year, last_year).select("lunar_day", "lunar_month", "lunar_year", "is_leap_month", "solar_date")
    return asked.join(c, ["lunar_day", "lunar_month", "lunar_year", "is_leap_month"], "left")
