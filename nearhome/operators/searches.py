"""Saved searches that a listing matches: by distance, price interval, and equal codes.

The join is by cells. A search takes the finest grid whose cells are at least as large as the box around its circle, so it lies in four
cells at most; its price interval likewise takes the finest steps that hold it in two. A listing is looked up once per pair of grid and
steps in use. Candidates are then refined by the great-circle distance, the true interval and the codes. Cells of hot places are divided by
price, and Spark divides what is still hot at run time.

Totals per search are taken without going through all pairs: listings alike in place, price and codes are looked up once, and searches
that ask the same are answered once.

Missing bounds are open, missing codes fit everything; without a radius or a place a search is for the whole world. Listings without a
price, or without a place, match only searches that do not ask for one. A bound that is NaN matches nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearhome.session import written

EARTH = 6371.0  # km
FINEST = 16  # halvings of the world
STEPS = range(-4, 40)  # widths of price steps as powers of two
ANY = -99  # the step of a search without a bound on either side
SLACK = 1e-9
TASK_LOOKUPS = 250_000  # of listings in grids and steps, in one task


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km of places in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def _row(lat: Column, level: Column) -> Column:
    n = F.pow(F.lit(2.0), level)
    return F.greatest(F.lit(0), F.least(n.cast("long") - 1, F.floor((lat + 90) / 180 * n))).cast("long")


def _column(lon: Column, level: Column) -> Column:
    n = F.pow(F.lit(2.0), level)
    return F.pmod(F.floor((lon + 180) / 360 * n), n.cast("long")).cast("long")


def _keys(level: Column, row: Column, column: Column, step: Column, price: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), row.alias("row"), column.alias("column"), step.cast("int").alias("step"), price.cast("long").alias("price"))


def _is_placed() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("radius").isNotNull()


def search_cells(searches: DataFrame) -> DataFrame:
    """``searches`` with the ``cell`` each lies in, one row a cell."""
    placed = _is_placed()
    reach = F.degrees(F.col("radius") / EARTH) * (1 + SLACK) + SLACK
    polar = F.abs("latitude") + reach >= 90
    width = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians("latitude"))))) + SLACK)
    finest = F.least(F.lit(float(FINEST)), F.log2(180 / (2 * reach)), F.log2(360 / (2 * width)))
    level = F.when(placed, F.greatest(F.lit(0), F.floor(finest))).otherwise(0)
    rows = searches.withColumns({"reach": reach, "width": width, "level": level})
    whole = F.col("level") == 0
    between = lambda low, high: F.sequence(low, high)
    lat_cells = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(between(_row(F.col("latitude") - F.col("reach"), F.col("level")), _row(F.col("latitude") + F.col("reach"), F.col("level"))))
    sides = F.array(_column(F.col("longitude") - F.col("width"), F.col("level")), _column(F.col("longitude") + F.col("width"), F.col("level")))
    lon_cells = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(sides))
    bounded = F.col("min_prix").isNotNull() & F.col("max_prix").isNotNull() & (F.col("min_prix") <= F.col("max_prix"))
    span = F.greatest(F.col("max_prix") - F.col("min_prix"), F.lit(2.0 ** STEPS[0]))
    step = F.when(bounded, F.greatest(F.lit(STEPS[0]), F.ceil(F.log2(span)))).otherwise(ANY)
    rows = rows.withColumns({"lat_cell": F.explode(lat_cells), "step": step}).withColumn("lon_cell", F.explode(lon_cells))
    step_of = lambda price: F.floor(price / F.pow(F.lit(2.0), F.col("step")))
    prices = F.when(F.col("step") == ANY, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(step_of(F.col("min_prix")), step_of(F.col("max_prix")))))
    rows = rows.withColumn("price_cell", F.explode(prices))
    cell = _keys(F.col("level"), F.col("lat_cell"), F.col("lon_cell"), F.col("step"), F.col("price_cell"))
    return rows.select(*searches.columns, cell.alias("cell"))


def matched_searches(listings: DataFrame, searches: DataFrame, codes: Sequence[str] = ("type_bien",)) -> DataFrame:
    """(search_id, listing_id, distance): every saved search with every listing that matches it; distance is null without a place.

    ``searches`` are (id, min_prix, max_prix, latitude, longitude, radius in km, and ``codes``), ``listings`` (id, prix, latitude,
    longitude, and the same codes).
    """
    asked = searches.select(F.col("id").alias("search_id"), "min_prix", "max_prix", "latitude", "longitude", "radius", *codes)
    cells = written(search_cells(asked), "search-cells")
    in_use = written(cells.select("cell.level", "cell.step").distinct(), "search-grids")  # (FINEST + 1) * (STEPS + 1) rows at most
    tasks = ceil(listings.count() * in_use.count() / TASK_LOOKUPS)  # a small table of listings has many lookups
    own = listings.select(
        F.col("id").alias("listing_id"), F.col("prix").alias("l_prix"), F.col("latitude").alias("l_lat"), F.col("longitude").alias("l_lon"),
        *[F.col(c).alias(f"l_{c}") for c in codes],
    )
    fits = ((F.col("level") == 0) | (F.col("l_lat").isNotNull() & F.col("l_lon").isNotNull())) & ((F.col("step") == ANY) | F.col("l_prix").isNotNull())
    looked = (own.repartition(tasks) if tasks > 1 else own).join(F.broadcast(in_use), fits)
    level, step = F.col("level"), F.col("step")
    row = F.when(level == 0, F.lit(0).cast("long")).otherwise(_row(F.col("l_lat"), level))
    column = F.when(level == 0, F.lit(0).cast("long")).otherwise(_column(F.col("l_lon"), level))
    price = F.when(step == ANY, F.lit(0).cast("long")).otherwise(F.floor(F.col("l_prix") / F.pow(F.lit(2.0), step)))
    pairs = cells.join(looked.withColumn("cell", _keys(level, row, column, step, price)).drop("level", "step"), "cell")
    distance = haversine(F.col("latitude"), F.col("longitude"), F.col("l_lat"), F.col("l_lon"))
    placed = _is_placed()
    near = ~placed | F.coalesce(distance <= F.col("radius"), F.lit(False))
    low = F.col("min_prix").isNull() | F.coalesce(F.col("l_prix") >= F.col("min_prix"), F.lit(False))
    high = F.col("max_prix").isNull() | F.coalesce(F.col("l_prix") <= F.col("max_prix"), F.lit(False))
    same = near & low & high
    for c in codes:
        same = same & (F.col(c).isNull() | F.coalesce(F.col(c) == F.col(f"l_{c}"), F.lit(False)))
    return pairs.filter(same).select("search_id", "listing_id", F.when(placed, distance).alias("distance"))


def search_totals(listings: DataFrame, searches: DataFrame, codes: Sequence[str] = ("type_bien",)) -> DataFrame:
    """(search_id, n_listings, listings, nearest, farthest): the pairs of ``matched_searches`` counted, the sum of their listings' ids and
    the bounds of their distance. Searches without a match have no row.
    """
    alike = listings.groupBy("prix", "latitude", "longitude", *codes).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    alike = written(alike, "search-alike").withColumn("id", F.struct("n", "ids"))
    asked = searches.select("id", "min_prix", "max_prix", *[F.when(_is_placed(), F.col(c)).alias(c) for c in ("latitude", "longitude", "radius")], *codes)
    criteria = [c for c in asked.columns if c != "id"]
    kinds = written(asked.select(criteria).distinct().withColumn("id", F.monotonically_increasing_id()), "search-kinds")
    totals = matched_searches(alike, kinds, codes).groupBy("search_id").agg(
        F.sum("listing_id.n").alias("n"), F.sum("listing_id.ids").alias("ids"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"),
    )
    answers = written(kinds.join(totals, F.col("id") == F.col("search_id")).select(*[F.col(c).alias(f"k_{c}") for c in criteria], "n", "ids", "nearest", "farthest"), "search-answers")
    same = F.lit(True)
    for c in criteria:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return asked.join(answers, same).groupBy(F.col("id").alias("search_id")).agg(
        F.sum("n").alias("n_listings"), F.sum("ids").alias("listings"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"),
    )
