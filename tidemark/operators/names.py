"""Names of metrics, tag names and tag values: the dictionary, suggestions, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

KINDS = {"metrics": "metric", "tagk": "name", "tagv": "value"}


def name_table(points: DataFrame, generation=None) -> DataFrame:
    """``kind, gen, name`` of everything named in ``points``; kind is metric, name or value."""
    gen = generation if generation is not None else F.lit(0).cast("smallint")
    each = F.concat(
        F.array(F.struct(F.lit("metric").alias("kind"), F.col("metric").alias("name"))),
        F.transform(F.coalesce(F.map_keys("tags"), F.array().cast("array<string>")), lambda k: F.struct(F.lit("name").alias("kind"), k.alias("name"))),
        F.transform(F.coalesce(F.map_values("tags"), F.array().cast("array<string>")), lambda v: F.struct(F.lit("value").alias("kind"), v.alias("name"))),
    )
    return points.select(gen.alias("gen"), F.explode(each).alias("e")).where("e.name is not null").select("e.kind", "gen", "e.name").distinct()


def suggest(names: DataFrame, what: str, prefix: str, most: int = 25, generations: list[int] | None = None, *, per_generation: bool = True) -> DataFrame:
    """Names that start with ``prefix``, sorted: of each generation the first ``most``, or of all together.

    ``what``: metrics, tagk or tagv.
    """
    if what not in KINDS:
        raise ValueError(f"unknown kind of name {what!r}")
    rows = names.where((F.col("kind") == KINDS[what]) & F.col("name").startswith(prefix))
    if generations is not None:
        rows = rows.where(F.col("gen").isin(*generations))
    if not per_generation:
        return rows.select("name").distinct().orderBy("name").limit(most)
    rank = F.row_number().over(Window.partitionBy("gen").orderBy("name"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).select("name").distinct().orderBy("name")


def number_names(names: DataFrame) -> DataFrame:
    """Dense ids per kind and generation, in order of names.

    Names are sorted over ranges of tasks; ids are places within a range plus the counts
    of the ranges before it (a row for each range, kind and generation), so that no task
    orders all names of a kind.
    """
    keys = ["kind", "gen"]
    ranged = cut(names.select(*keys, "name").distinct().repartitionByRange(*keys, "name").withColumn("_range", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy("name"))
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", *keys, before.alias("_before"))
    return ranged.withColumn("_place", place).join(offsets, ["_range", *keys]).select(*keys, "name", (F.col("_before") + F.col("_place")).cast("int").alias("id"))


def store_names(names: DataFrame, path: str) -> None:
    """Add names to a stored dictionary: those it has not got yet, in order of names, by kind and generation."""
    spark = names.sparkSession
    fresh = names.select("kind", "gen", "name").distinct()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.parquet(path).withColumn("gen", F.col("gen").cast(fresh.schema["gen"].dataType))
        fresh = fresh.join(known, ["kind", "gen", "name"], "left_anti")
    fresh.repartitionByRange("kind", "gen", "name").sortWithinPartitions("kind", "gen", "name").write.mode("append").partitionBy("kind", "gen").parquet(path)


def resolve(rows: DataFrame, numbered: DataFrame, kind: str, column: str) -> DataFrame:
    """Inner lookup of a column's ids; rows with unknown names go."""
    ids = numbered.where(F.col("kind") == kind).select(F.col("name").alias(column), F.col("id").alias(f"{column}_id")).distinct()
    return rows.join(ids, column)
