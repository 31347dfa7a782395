"""The listing feature pipeline and the K-Means clusters."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.operators.numbering import numbered
from nearhome.schemas import KMEANS_CLUSTERS, KMEANS_SEED
from nearhome.session import written

CATEGORIES = ("type_bien", "lease_duration")
NUMBERS = ("prix", "latitude", "longitude")
PART_ROWS = 100_000  # listings whose vectors one training task keeps


def category_indices(listings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, idx, n), written: the index of every value of each column by falling frequency, equal ones alphabetically.

    All columns are counted in one pass and numbered together. The model holds this table, so a category may have any number of values.
    """
    named = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = listings.select(F.inline(named)).dropna().groupBy("column_name", "value").agg(F.count("*").alias("n"))
    placed = numbered(counts, [F.col("column_name"), F.col("n").desc(), F.col("value")], "idx", "category-index")
    first = placed.groupBy("column_name").agg(F.min("idx").alias("first"))  # one row a column
    return written(placed.join(first, "column_name").select("column_name", "value", (F.col("idx") - F.col("first")).alias("idx"), "n"), "category-indices")


def category_index(listings: DataFrame, column: str) -> DataFrame:
    """(value, idx, n) of one column, see ``category_indices``."""
    return category_indices(listings, [column]).select("value", "idx", "n")


def with_index(rows: DataFrame, column: str, index: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``<column>_index``, found by a join with the index; a value that is not in it gets the last number.

    The last number is that of the least frequent value, which one-hot encoding leaves out: both become zeros. Spark decides
    from the written index's size whether it is broadcast, and divides a hot value of a shuffled join at run time.
    """
    known = index.select(F.col("value").alias(column), F.col("idx").cast("double").alias(f"{column}_index"))
    return rows.join(known, column, "left").fillna(float(size - 1), [f"{column}_index"])


class FeatureModel:
    """The trained pipeline together with the category tables it looks values up in.

    ``indices`` maps a categorical column to its table (value, idx, n) and the number of its values; the tables stay where
    they are written, none of their values is on the driver. Saved and loaded like Spark's own models.
    """

    def __init__(self, pipeline: PipelineModel, indices: dict[str, tuple[DataFrame, int]]):
        self.pipeline, self.indices, self.stages = pipeline, indices, pipeline.stages

    def transform(self, rows: DataFrame) -> DataFrame:
        columns = rows.columns
        for column, (index, size) in self.indices.items():
            rows = with_index(rows, column, index, size)
        return self.pipeline.transform(rows.select(*columns, *[f"{c}_index" for c in self.indices]))

    def write(self) -> FeatureModel:
        return self

    def overwrite(self) -> FeatureModel:
        return self

    def save(self, path: str) -> None:
        for column, (index, _) in self.indices.items():
            index.write.mode("overwrite").parquet(f"{path}/index/{column}")
        spark = SparkSession.active()
        sizes = [(i, c, size) for i, (c, (_, size)) in enumerate(self.indices.items())]
        spark.createDataFrame(sizes, "place int, column string, size long").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
        self.pipeline.write().overwrite().save(f"{path}/pipeline")

    @classmethod
    def load(cls, path: str) -> FeatureModel:
        spark = SparkSession.active()
        sizes = spark.read.parquet(f"{path}/sizes").orderBy("place").collect()  # one row a column
        indices = {r["column"]: (spark.read.parquet(f"{path}/index/{r['column']}"), r["size"]) for r in sizes}
        return cls(PipelineModel.load(f"{path}/pipeline"), indices)


def encoder(sizes: dict[str, int]) -> list:
    """One-hot without the last index. The number of values is all that it learns, so it is fitted without the listings."""
    if not sizes:
        return []
    names = list(sizes)
    spark = SparkSession.active()
    last = spark.createDataFrame([tuple(float(sizes[c] - 1) for c in names)], ", ".join(f"`{c}_index` double" for c in names))
    return [OneHotEncoder(inputCols=[f"{c}_index" for c in names], outputCols=[f"{c}_encoded" for c in names]).fit(last)]


def fit_features(
    listings: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    clusters: int | None = KMEANS_CLUSTERS,
    seed: int = KMEANS_SEED,
    order: Sequence[str] | None = None,
) -> FeatureModel:
    """Index, encode, assemble and normalise; with ``clusters`` also K-Means on the normalised vectors.

    ``order`` names the assembled columns; by default the numbers, then the categories. Only the columns that are needed are
    read, so that long texts are not carried through the training. K-Means keeps the vectors of a partition in one task, and a
    small file of listings is one partition, so the listings are spread by their number.
    """
    needed = listings.select("id", *NUMBERS, *categories)
    found = category_indices(needed, categories)
    sizes = dict(found.groupBy("column_name").count().collect())  # one row a column
    used = [c for c in categories if sizes.get(c, 0) >= 2]  # a column with a single value tells nothing
    indices = {c: (found.filter(F.col("column_name") == c).select("value", "idx", "n"), sizes[c]) for c in used}
    inputs = [f"{c}_encoded" if c in categories else c for c in (order or [*NUMBERS, *categories]) if c not in categories or c in used]
    stages = [
        *encoder({c: size for c, (_, size) in indices.items()}),
        VectorAssembler(inputCols=inputs, outputCol="features"),
        Normalizer(inputCol="features", outputCol="norm_features", p=2.0),
    ]
    if clusters:
        stages.append(KMeans(featuresCol="norm_features", predictionCol="prediction", k=clusters, seed=seed))
    tasks = ceil(needed.count() / PART_ROWS) if clusters else 1
    rows = needed.repartition(tasks) if tasks > 1 else needed
    for column, (index, size) in indices.items():
        rows = with_index(rows, column, index, size)
    return FeatureModel(Pipeline(stages=stages).fit(rows), indices)


def scored_listings(model: FeatureModel, listings: DataFrame) -> DataFrame:
    """(id, prix, features, norm_features, prediction) of the catalogue."""
    scored = model.transform(listings)
    wanted = [c for c in ("id", "prix", "features", "norm_features", "prediction") if c in scored.columns]
    return scored.select(*wanted)


def feature_arrays(scored: DataFrame) -> DataFrame:
    """(id, vec): the normalised vectors as plain arrays."""
    return scored.select("id", vector_to_array("norm_features").alias("vec"))


def centre_distances(model: FeatureModel, scored: DataFrame) -> DataFrame:
    """(id, prediction, own, nearest): squared distance to the own centre and to the nearest one."""
    centres = [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]
    vec = vector_to_array("norm_features")
    gap = lambda c: F.aggregate(F.zip_with("vec", F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return (
        scored
        .select("id", "prediction", vec.alias("vec"))
        .select("id", "prediction", F.array(*map(gap, centres)).alias("gaps"))
        .select("id", "prediction", F.get("gaps", F.col("prediction")).alias("own"), F.array_min("gaps").alias("nearest"))
    )
