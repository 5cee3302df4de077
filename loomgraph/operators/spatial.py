"""Coordinates: the four filling strategies, the geocode fallback chain, bounding-box checks and coverage gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schemas import LAT_MAX, LAT_MIN, LON_MAX, LON_MIN

#: Province centroids (fixed values).
PROVINCES = {
    "Điện Biên": (21.3860, 103.0230), "Lai Châu": (22.3860, 103.1580), "Lào Cai": (22.4809, 103.9755), "Sơn La": (21.3256, 103.9188), "Cao Bằng": (22.6667, 106.2500), "Lạng Sơn": (21.8530, 106.7610),
    "Phú Thọ": (21.3227, 105.4021), "Thái Nguyên": (21.5944, 105.8480), "Tuyên Quang": (21.8233, 105.2280), "Quảng Ninh": (20.9500, 107.0833), "Bắc Ninh": (21.1861, 106.0763), "Thành phố Hải Phòng": (20.8449, 106.6881),
    "Hưng Yên": (20.6464, 106.0512), "Ninh Bình": (20.2506, 105.9744), "Thanh Hóa": (19.8067, 105.7764), "Nghệ An": (18.6796, 105.6813), "Hà Tĩnh": (18.3428, 105.9057), "Quảng Trị": (16.8163, 107.1000),
    "Thành phố Huế": (16.4637, 107.5909), "Thành phố Đà Nẵng": (16.0544, 108.2022), "Quảng Ngãi": (15.1214, 108.8044), "Khánh Hòa": (12.2388, 109.1967), "Gia Lai": (13.9833, 108.0000), "Đăk Lăk": (12.6667, 108.0500),
    "Lâm Đồng": (11.9404, 108.4583), "Thành phố Đồng Nai": (10.9447, 106.8243), "Tây Ninh": (11.3100, 106.0989), "Thành phố Hồ Chí Minh": (10.7769, 106.7009), "Đồng Tháp": (10.4590, 105.6323), "An Giang": (10.3860, 105.4351),
    "Vĩnh Long": (10.2537, 105.9722), "Thành phố Cần Thơ": (10.0452, 105.7469), "Cà Mau": (9.1769, 105.1524),
}


def province_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PROVINCES.items()], "name string, lat double, lon double")


def in_box(lat: Column, lon: Column) -> Column:
    """Inclusive box test; a missing coordinate is not wrong."""
    return F.when(lat.isNull() | lon.isNull(), F.lit(True)).otherwise(lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX))


def fill_pair(df: DataFrame, cond: Column, to: str, lat: Column, lon: Column) -> DataFrame:
    """Set both coordinates of one side under the same condition."""
    return df.withColumns({f"l_{to}_lat": F.when(cond, lat).otherwise(F.col(f"l_{to}_lat")), f"l_{to}_lon": F.when(cond, lon).otherwise(F.col(f"l_{to}_lon"))})


def copy_tail_to_head(df: DataFrame) -> DataFrame:
    """Strategy 1: people without head coordinates take those of the place (which may be null)."""
    return fill_pair(df, F.col("r").isin("bornIn", "diedIn") & F.col("l_h_lat").isNull(), "h", F.col("l_t_lat"), F.col("l_t_lon"))


def events_take_tail(df: DataFrame) -> DataFrame:
    """Strategy 4: events without head coordinates take a known tail's; runs after the tails were geocoded."""
    return fill_pair(df, (F.col("r") == "occurredAt") & F.col("l_h_lat").isNull() & F.col("l_t_lat").isNotNull(), "h", F.col("l_t_lat"), F.col("l_t_lon"))


def geocode(df: DataFrame, label: str, side: str, places: DataFrame) -> DataFrame:
    """Strategies 2 and 3: rows without coordinates look up their label. places(name, lat, lon) holds one row per name."""
    p = places.select(F.col("name").alias("__name"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    joined = df.join(p, (F.trim(F.col(label)) == F.col("__name")) & F.col(f"l_{side}_lat").isNull(), "left")
    return fill_pair(joined, F.col("__name").isNotNull(), side, F.col("__lat"), F.col("__lon")).drop("__name", "__lat", "__lon")


def enrich(df: DataFrame, places: DataFrame) -> DataFrame:
    """Strategies 1 to 4 in order."""
    return df.transform(copy_tail_to_head).transform(geocode, "h_label", "h", places).transform(geocode, "t_label", "t", places).transform(events_take_tail)


def lookup_chain(names: DataFrame, cache: DataFrame, *resolvers: DataFrame) -> DataFrame:
    """Coordinates of each distinct name: the cache first, where a recorded miss (null lat) also counts, then the resolvers in order.

    names(name); cache and resolvers(name, lat, lon). Returns (name, lat, lon, origin), misses with origin `miss`, ready to be the next cache.
    """
    out = names.where(F.trim("name") != "").select(F.trim("name").alias("name")).distinct()
    out = out.join(cache.select("name", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.lit(True).alias("cached")), "name", "left")
    lats, lons, tags = [], [], []
    for i, r in enumerate(resolvers, 1):
        out = out.join(r.select("name", F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}")), "name", "left")
        lats.append(F.col(f"lat{i}"))
        lons.append(F.when(F.col(f"lat{i}").isNotNull(), F.col(f"lon{i}")))
        tags.append(F.when(F.col(f"lat{i}").isNotNull(), F.lit(f"resolver{i}")))
    known = F.col("cached").isNotNull()
    nil = F.lit(None).cast("double")
    return out.select(
        "name", F.when(known, F.col("lat0")).otherwise(F.coalesce(*lats, nil)).alias("lat"), F.when(known, F.col("lon0")).otherwise(F.coalesce(*lons, nil)).alias("lon"),
        F.when(known & F.col("lat0").isNotNull(), "cache").when(known, "miss").otherwise(F.coalesce(*tags, F.lit("miss"))).alias("origin"),
    )


def share(cond: Column, places: int = 6) -> Column:
    """Share of rows where cond holds, null on empty input."""
    return F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), places)


def coverage(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("l_h_lat").isNotNull()).alias("cov_h"), share(F.col("l_t_lat").isNotNull()).alias("cov_t"))


def gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: passed, and the names of the failed checks joined by '; '. checks are aggregate conditions; null counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.agg(failed.alias("f")).select((F.size("f") == 0).alias("passed"), F.array_join("f", "; ").alias("failed"))
