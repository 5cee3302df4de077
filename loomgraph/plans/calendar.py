"""Queries on the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import calendar as cal
from loomgraph.plans.base import Book
from loomgraph.session import table

book = Book()
_JD = "(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588)"
_ARR = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"


@book.add("calendar_day_number", f"SELECT o_orderkey, CAST({_JD} AS BIGINT) AS jd FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.day_number(F.to_date("o_orderdate")).cast("long").alias("jd"))


@book.add("calendar_date_of", "SELECT o_orderkey, CAST(DATE '1970-01-01' + CAST(2440588 + o_orderkey % 40000 - 2440588 AS INTEGER) AS DATE) AS d FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.date_of(2440588 + F.col("o_orderkey") % 40000).alias("d"))


@book.add("calendar_day_name", f"SELECT o_orderkey, {_ARR(cal.STEMS)}[({_JD} + 9) % 10 + 1] || ' ' || {_ARR(cal.BRANCHES)}[({_JD} + 1) % 12 + 1] AS name FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.day_name(cal.day_number(F.to_date("o_orderdate"))).alias("name"))


@book.add("calendar_year_name", f"SELECT row_id, {_ARR(cal.STEMS)}[((tau_start + 6) % 10 + 10) % 10 + 1] || ' ' || {_ARR(cal.BRANCHES)}[((tau_start + 8) % 12 + 12) % 12 + 1] AS name FROM historical_events WHERE tau_start IS NOT NULL")
def _(spark, d):
    return table(spark, d, "historical_events").where("tau_start is not null").select("row_id", cal.year_name(F.col("tau_start")).alias("name"))


_T = "((jd - 2451545.0::DOUBLE) / 36525.0::DOUBLE)"


@book.add("calendar_sun_longitude", f"""WITH j AS (SELECT o_orderkey, CAST({_JD} AS DOUBLE) AS jd FROM orders), t AS (SELECT o_orderkey, {_T} AS t FROM j), l AS (SELECT o_orderkey, (280.46646::DOUBLE + 36000.76983::DOUBLE * t + 0.0003032::DOUBLE * t * t + (1.9146::DOUBLE - 0.004817::DOUBLE * t - 0.000014::DOUBLE * t * t) * sin((357.5291::DOUBLE + 35999.0503::DOUBLE * t - 0.0001559::DOUBLE * t * t - 0.00000048::DOUBLE * t * t * t) * pi() / 180)
      + 0.019993::DOUBLE * sin(2 * (357.5291::DOUBLE + 35999.0503::DOUBLE * t - 0.0001559::DOUBLE * t * t - 0.00000048::DOUBLE * t * t * t) * pi() / 180) - 0.00569::DOUBLE - 0.00478::DOUBLE * sin((125.04::DOUBLE - 1934.136::DOUBLE * t) * pi() / 180)) * pi() / 180 AS lon FROM t)
    SELECT o_orderkey, round(lon - 2 * pi() * floor(lon / (2 * pi())), 6) AS lon FROM l""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(cal.sun_longitude(cal.day_number(F.to_date("o_orderdate")).cast("double")), 6).alias("lon"))


def _poly(t: str, *c: float) -> str:
    out = f"{float(c[-1])!r}::DOUBLE"
    for x in reversed(c[:-1]):
        out = f"({out} * {t} + {float(x)!r}::DOUBLE)"
    return out


def _moon_sql(k: str) -> str:
    """The new-moon formula as DuckDB text."""
    t, rad = f"({k} / 1236.85::DOUBLE)", "(pi() / 180)"
    sun = f"(359.2242::DOUBLE + 29.10535608::DOUBLE * {k} + {_poly(t, 0, 0, -0.0000333, -0.00000347)})"
    moon = f"(306.0253::DOUBLE + 385.81691806::DOUBLE * {k} + {_poly(t, 0, 0, 0.0107306, 0.00001236)})"
    lat = f"(21.2964::DOUBLE + 390.67050646::DOUBLE * {k} + {_poly(t, 0, 0, -0.0016528, -0.00000239)})"
    wave = " + ".join(f"({a!r}::DOUBLE + {float(c)!r}::DOUBLE * {t}) * sin(({s} * {sun} + {m} * {moon} + {f} * {lat}) * {rad})" for a, c, s, m, f in cal.MOON_TERMS)
    mean = f"2415020.75933::DOUBLE + 29.53058868::DOUBLE * {k} + {_poly(t, 0, 0, 0.0001178, -0.000000155)} + 0.00033::DOUBLE * sin({_poly(t, 166.56, 132.87, -0.009173)} * {rad})"
    shift = f"CASE WHEN {t} < -11 THEN {_poly(t, 0.001, 0.000839, 0.0002261, -0.00000845, -0.000000081)} ELSE {_poly(t, -0.000278, 0.000265, 0.000262)} END"
    return f"({mean} + {wave} - {shift})"


def _sun_sql(jd: str) -> str:
    t, rad = f"(({jd} - 2451545.0::DOUBLE) / 36525.0::DOUBLE)", "(pi() / 180)"
    m = f"({_poly(t, 357.5291, 35999.0503, -0.0001559, -0.00000048)} * {rad})"
    lon = f"(({_poly(t, 280.46646, 36000.76983, 0.0003032)} + {_poly(t, 1.9146, -0.004817, -0.000014)} * sin({m}) + 0.019993::DOUBLE * sin(2 * {m}) - 0.00569::DOUBLE - 0.00478::DOUBLE * sin((125.04::DOUBLE - 1934.136::DOUBLE * {t}) * {rad})) * {rad})"
    return f"({lon} - 2 * pi() * floor({lon} / (2 * pi())))"


def _months_sql(first: int, last: int) -> str:
    """The month table as DuckDB text."""
    k0, k1 = int((first - 1900) * 12.3685) - 30, int((last - 1900) * 12.3685) + 45
    return f"""m0 AS (SELECT k, CAST(trunc({_moon_sql('CAST(k AS DOUBLE)')} + 0.5::DOUBLE + 7.0::DOUBLE / 24) AS BIGINT) AS start FROM (SELECT unnest(range({k0}, {k1})) AS k)),
    m1 AS (SELECT *, CAST(floor({_sun_sql('(start - 0.5::DOUBLE - 7.0::DOUBLE / 24)')} / (pi() / 6)) AS INTEGER) AS sec FROM m0), m2 AS (SELECT *, lead(start) OVER (ORDER BY k) AS next_start, lead(sec) OVER (ORDER BY k) AS next_sec FROM m1),
    m3 AS (SELECT *, sum(CASE WHEN sec < 9 AND next_sec >= 9 AND sec >= 6 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS cycle FROM m2), m4 AS (SELECT *, count(*) OVER (PARTITION BY cycle) AS n, row_number() OVER (PARTITION BY cycle ORDER BY k) - 1 AS i FROM m3),
    m5 AS (SELECT *, min(CASE WHEN n = 13 AND sec = next_sec AND i > 0 THEN i END) OVER (PARTITION BY cycle) AS leap_at, first_value(year(DATE '1970-01-01' + CAST(start - 2440588 AS INTEGER))) OVER (PARTITION BY cycle ORDER BY k) AS y FROM m4),
    mon AS (SELECT start, next_start, CAST((i - coalesce(CASE WHEN i >= leap_at THEN 1 ELSE 0 END, 0) + 10) % 12 + 1 AS INTEGER) AS lunar_month, CAST(y + CASE WHEN i - coalesce(CASE WHEN i >= leap_at THEN 1 ELSE 0 END, 0) >= 2 THEN 1 ELSE 0 END AS INTEGER) AS lunar_year, coalesce(i = leap_at, false) AS leap FROM m5 WHERE cycle > 0 AND next_start IS NOT NULL)"""


def _name_sql(n: str, a: int, b: int) -> str:
    return f"{_ARR(cal.STEMS)}[({n} + {a}) % 10 + 1] || ' ' || {_ARR(cal.BRANCHES)}[({n} + {b}) % 12 + 1]"


def _days_sql(first: int, last: int) -> str:
    return f"""{_months_sql(first, last)}, dy AS (SELECT *, unnest(range(start, next_start)) AS jd FROM mon), dd AS (SELECT *, CAST(DATE '1970-01-01' + CAST(jd - 2440588 AS INTEGER) AS DATE) AS solar_date FROM dy),
    cal AS (SELECT solar_date, CAST(day(solar_date) AS INTEGER) AS solar_day, CAST(month(solar_date) AS INTEGER) AS solar_month, CAST(year(solar_date) AS INTEGER) AS solar_year, CAST(jd - start + 1 AS INTEGER) AS lunar_day, lunar_month, lunar_year, CAST(leap AS INTEGER) AS is_leap_month, {_name_sql('lunar_year', 6, 8)} AS can_chi_year, {_name_sql('jd', 9, 1)} AS can_chi_day FROM dd WHERE year(solar_date) BETWEEN {first} AND {last})"""


@book.add("calendar_new_moons", f"SELECT k, round({_moon_sql('CAST(k AS DOUBLE)')}, 6) AS jd, CAST(trunc({_moon_sql('CAST(k AS DOUBLE)')} + 0.5::DOUBLE + 7.0::DOUBLE / 24) AS BIGINT) AS day FROM (SELECT unnest(range(1200, 1700)) AS k)")
def _(spark, d):
    return spark.range(1200, 1700).select(F.col("id").alias("k"), F.round(cal.new_moon(F.col("id")), 6).alias("jd"), cal.moon_day(F.col("id")).alias("day"))


@book.add("calendar_months", f"WITH {_months_sql(2000, 2030)} SELECT * FROM mon")
def _(spark, d):
    return cal.months(spark, 2000, 2030)


@book.add("calendar_table", f"WITH {_days_sql(2000, 2030)} SELECT * FROM cal")
def _(spark, d):
    return cal.calendar(spark, 2000, 2030)


@book.add("calendar_order_dates", f"WITH {_days_sql(1995, 2001)} SELECT o_orderkey, lunar_day, lunar_month, lunar_year, is_leap_month FROM orders JOIN cal ON CAST(o_orderdate AS DATE) = solar_date")
def _(spark, d):
    c = cal.calendar(spark, 1995, 2001)  # 2,557 days, fixed
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("solar_date")).join(F.broadcast(c), "solar_date").select("o_orderkey", "lunar_day", "lunar_month", "lunar_year", "is_leap_month")


@book.add("calendar_lunar_to_solar", f"WITH {_days_sql(2000, 2022)} SELECT o_orderkey, solar_date FROM orders LEFT JOIN cal ON lunar_day = 1 + o_orderkey % 30 AND lunar_month = 1 + o_orderkey % 12 AND lunar_year = 2001 + o_orderkey % 20 AND is_leap_month = 0")
def _(spark, d):
    asked = table(spark, d, "orders").selectExpr("o_orderkey", "cast(1 + o_orderkey % 30 as int) as lunar_day", "cast(1 + o_orderkey % 12 as int) as lunar_month", "cast(2001 + o_orderkey % 20 as int) as lunar_year", "cast(0 as int) as is_leap_month")
    return cal.lunar_to_solar(asked, 2000, 2022).select("o_orderkey", "solar_date")
