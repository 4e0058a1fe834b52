"""Scans and sinks: permit CSV, manifest lines, GeoJSON, caches, partitioned objects."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.urls import detail_id


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir``. Where a session of one machine has none, a local one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = getattr(spark, "_factloom_files", None) or tempfile.mkdtemp(prefix="factloom-")
        spark._factloom_files = base
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared folder, where the session has not named a folder itself."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


def permits_csv(spark: SparkSession, path: str, columns: list[str], url_column: str) -> DataFrame:
    """All columns as text, the id from the url; rows without one are dropped. A quoted cell can hold line breaks."""
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumn("detail_id", detail_id(F.col(url_column))).where("detail_id is not null")


def manifest_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``_ord, line`` with the parsed ``record`` and whether the line is torn; blank lines are neither."""
    kind = F.when(F.trim("line") == "", "blank").when(F.try_parse_json("line").isNull(), "torn").otherwise("record")
    return lines.withColumns({"kind": kind, "record": F.when(kind == "record", F.from_json("line", schema))})


def torn(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'torn'").select("_ord", F.length("line").alias("length"), F.left("line", F.lit(100)).alias("preview"))


def feature_label(properties: list[Column], kind: Column, fallback: str) -> Column:
    """First property that is neither blank nor the text null, else the kind, else the fallback."""
    some = [F.when((F.trim(p) != "") & (F.lower(F.trim(p)) != "null"), F.trim(p)) for p in properties]
    return F.coalesce(*some, kind, F.lit(fallback))


GEOJSON = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def geojson_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of line layers (MultiLineString): ``feature, part, seg, lon1, lat1, lon2, lat2, properties``; empty geometries are dropped."""
    f = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    parts = f.where("f.geometry is not null").select("feature", F.col("f.properties").alias("properties"), F.posexplode("f.geometry.coordinates").alias("part", "line"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda i: F.struct(i.alias("seg"), F.get("line", i).alias("a"), F.get("line", i + 1).alias("b")))
    out = parts.where("size(line) >= 2").select("feature", "part", "properties", F.explode(pairs).alias("s"))
    return out.select("feature", "part", F.col("s.seg").alias("seg"), *[F.get(f"s.{p}", F.lit(i)).alias(n) for p, i, n in (("a", 0, "lon1"), ("a", 1, "lat1"), ("b", 0, "lon2"), ("b", 1, "lat2"))], "properties")


#: GeoJSON's nesting of coordinates by type, as an array of shapes, each of rings or lines of points.
_NESTING = {"LineString": ("array<array<double>>", 2), "MultiLineString": ("array<array<array<double>>>", 1), "Polygon": ("array<array<array<double>>>", 1), "MultiPolygon": ("array<array<array<array<double>>>>", 0)}


def geojson_shapes(spark: SparkSession, path: str, project: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Lines and polygons of GeoJSON: ``feature, part, kind, rings, properties``, ``rings`` of points ``x, y``; a MultiLineString is one part.

    ``project`` makes a struct of two fields of longitude and latitude. Rings are closed, without repeated points, the outer one against the clock and holes with it; rings of fewer than three points,
    lines of fewer than two and points with a null are left out, and so are shapes of which nothing remains, other types and empty geometries. Rings that touch or cross
    themselves stay as they are: inside is where a ray crosses an odd number of edges.
    """
    from factloom.operators.polygons import clean_ring, oriented

    schema = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    f = f.select("feature", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("_type"), F.col("f.geometry.coordinates").alias("_c"))
    shapes = F.lit(None).cast("array<array<array<array<double>>>>")
    for kind, (nesting, wraps) in _NESTING.items():
        one = F.from_json("_c", nesting)
        for _ in range(wraps):
            one = F.array(one)
        shapes = F.when(F.col("_type") == kind, one).otherwise(shapes)

    def point(p: Column) -> Column:
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        if project is None:
            return F.struct(x.alias("x"), y.alias("y"))
        return project(x, y).cast("struct<x: double, y: double>")

    parts = f.select("feature", "properties", F.when(F.endswith("_type", F.lit("Polygon")), "polygon").otherwise("line").alias("kind"), F.posexplode(shapes).alias("part", "_s"))
    lines = F.transform("_s", lambda r: F.transform(r, point))
    whole = lambda r: F.filter(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    drawn = F.filter(F.transform(lines, whole), lambda r: F.size(r) >= 2)
    closed = F.transform(lines, clean_ring)
    # a polygon whose outer ring is gone has no holes either
    closed = F.when(F.get(closed, F.lit(0)).isNotNull(), oriented(F.filter(closed, lambda r: r.isNotNull())))
    out = parts.withColumn("rings", F.when(F.col("kind") == "polygon", closed).otherwise(drawn))
    return out.where("size(rings) > 0").select("feature", "part", "kind", "rings", "properties")


def cache_key(content: Column) -> Column:
    return F.left(F.sha2(content.cast("binary"), 256), F.lit(32))


def not_cached(work: DataFrame, cache: DataFrame, content: str) -> DataFrame:
    """What the cache doesn't hold yet, by content."""
    return work.withColumn("key", cache_key(F.col(content))).join(cache.select("key"), "key", "left_anti")


def write_by_status(df: DataFrame, path: str, status: str = "status") -> None:
    """The layout ``status=.../part``, one task for each part of a status' rows."""
    df.write.partitionBy(status).mode("overwrite").parquet(path)


def is_pdf(content: Column) -> Column:
    return F.startswith(content, F.lit("%PDF-"))


def put_objects(objects: DataFrame, there: DataFrame, path: str | None) -> DataFrame:
    """Store ``key, body`` once: ``key, status, bytes, md5, sha256`` of each, the digests only of what is a PDF.

    A body that doesn't begin as a PDF is refused, a key that ``there`` has is left alone, and without a ``path`` nothing is written (a dry run).
    Where a key comes several times in one run, the PDF with the smallest digest is stored and the others exist already; copies of one body are told as one stored and the rest existing.
    Objects go to Parquet below ``path``, a part for each first letter of the key's digest; keys repeat their last write nowhere, for a run adds only what wasn't there.
    """
    body = F.col("body").cast("binary")
    known = there.select("key").distinct().withColumn("_there", F.lit(True))
    seen = objects.join(known, "key", "left").withColumn("_pdf", F.coalesce(F.startswith(body, F.lit("%PDF").cast("binary")), F.lit(False)))
    # who is first of its key, by digest
    seen = seen.withColumn("_digest", F.sha2(body, 256))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_pdf"), "_digest")) == 1
    status = F.when(~F.col("_pdf"), "not-a-pdf").when(F.col("_there") | ~F.col("_first"), "exists").otherwise("uploaded" if path else "dry-run")
    out = seen.withColumn("_first", first).withColumn("status", status)
    if path:  # decided once: what is told and what is written are the same rows
        checkpoint_dir(objects.sparkSession)
        out = out.checkpoint()
    if path:
        out.where("status = 'uploaded'").select("key", "body", F.left(F.md5(F.col("key").cast("binary")), F.lit(1)).alias("part")).write.mode("append").partitionBy("part").parquet(path)
    pdf = lambda c: F.when(F.col("_pdf"), c)
    return out.select("key", "status", F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("bytes"), pdf(F.md5(body)).alias("md5"), pdf(F.sha2(body, 256)).alias("sha256"))
