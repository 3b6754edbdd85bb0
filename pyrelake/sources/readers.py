"""File sources: detection CSV, GeoJSON areas and provinces, object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = "latitude double, longitude double, brightness double, bright_ti4 double, bright_t31 double, bright_ti5 double, confidence string, acq_date string, acq_time string, frp double, daynight string, satellite string, instrument string, _corrupt string"


def detections_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Satellite detections; malformed lines keep their text in ``_corrupt``. ``limit`` is the reader's row limit."""
    df = spark.read.schema(CSV).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return df if limit is None else df.limit(limit)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: properties (a map), kind and coordinates (JSON text) of its geometry."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def first_of(properties: str, names: list[str]) -> Column:
    """The first property that is set, of candidate names."""
    return F.coalesce(*[F.element_at(properties, F.lit(n)) for n in names])


def provinces(spark: SparkSession, path: str) -> DataFrame:
    """Province polygons; name is the first set one of the usual properties."""
    return geojson(spark, path).select(first_of("properties", ["nam", "fna", "nombre"]).alias("name"), "kind", "coordinates")


def ring(coordinates: Column) -> Column:
    """The outer ring of a GeoJSON polygon as an array of (lon, lat)."""
    return F.transform(F.get(F.from_json(coordinates, "array<array<array<double>>>"), F.lit(0)), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def objects(spark: SparkSession, path: str, prefix: str = "*") -> DataFrame:
    """Listing of stored objects without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", prefix).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
