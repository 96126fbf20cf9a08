"""GeoJSON features to and from tables.

Geometry columns are plain nested data: a point is ``struct<x,y>``, a line an array of points, a polygon an
array of rings (outer first), and a multi-part geometry an array of those. The readers give ``point``, ``points``,
``lines`` and ``polygons``; the last two hold an array of parts for single-part features too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}

_FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:{props}>"


def _xy(c: Column) -> Column:
    return F.struct(c[0].alias("x"), c[1].alias("y"))


def _nested(c: Column, depth: int) -> Column:
    return _xy(c) if depth == 0 else F.transform(c, lambda part: _nested(part, depth - 1))


def parse_coordinates(text: Column, kind: str) -> Column:
    """Coordinate text of one geometry type to its nested column; extra dimensions are dropped."""
    depth = DEPTH[kind]
    schema = "array<" * (depth + 1) + "double" + ">" * (depth + 1)
    return _nested(F.from_json(text, schema), depth)


def _geometry_columns(df: DataFrame, more: list[str] | None = None) -> DataFrame:
    kind = F.col("geometry.type")
    text = F.col("geometry.coordinates")
    return df.select(
        kind.alias("geometry_type"),
        F.when(kind == "Point", parse_coordinates(text, "Point")).alias("point"),
        F.when(kind == "MultiPoint", parse_coordinates(text, "MultiPoint")).alias("points"),
        F.when(kind == "LineString", F.array(parse_coordinates(text, "LineString")))
        .when(kind == "MultiLineString", parse_coordinates(text, "MultiLineString"))
        .alias("lines"),
        F.when(kind == "Polygon", F.array(parse_coordinates(text, "Polygon")))
        .when(kind == "MultiPolygon", parse_coordinates(text, "MultiPolygon"))
        .alias("polygons"),
        "properties.*",
        *(more or []),
    )


# what a collection written over several lines has around its features
_WRAPPER = r"""^(\{.*"features"\s*:\s*\[|[\[\]{}, ]+|"(type|name|crs|bbox|features)"\s*:.*)$"""


def read_geojson(spark: SparkSession, path: str, properties: str, broken: str = "raise") -> DataFrame:
    """Features in text files as a table: one feature or one whole collection per line, or a collection's lines.

    ``properties`` is the DDL of the attributes. Features without geometry are kept. A line that is no feature fails the
    query; with ``broken="keep"`` it comes back as a row with the line in ``broken``. A collection on one line is one
    task here however large it is: write big layers one feature per line (as ``write_features`` does), or read them by
    ``read_geojson_document``.
    """
    feature = _FEATURE.format(props=f"struct<{properties}>")
    either = feature[:-1] + f",features:array<{feature}>>"
    line = F.regexp_replace(F.trim("value"), ",$", "")
    raw = spark.read.text(path).select(line.alias("line")).filter(
        (F.col("line") != "") & (F.col("line").contains('"Feature"') | ~F.col("line").rlike(_WRAPPER))
    )
    parsed = raw.select("line", F.from_json("line", either).alias("f"))
    one = F.array(F.struct("f.type", "f.geometry", "f.properties"))
    wrong = F.raise_error(F.concat(F.lit("not a GeoJSON feature: "), F.substring("line", 1, 200))) if broken == "raise" else None
    unread = F.array(F.struct(F.lit(None).alias("type"), F.lit(None).alias("geometry"), F.lit(None).alias("properties")).cast(feature))
    kind = F.col("f.type")
    features = (
        F.when(kind == "Feature", one).when(kind == "FeatureCollection", F.coalesce("f.features", F.array().cast(f"array<{feature}>")))
        .otherwise(F.lit(wrong).cast(f"array<{feature}>") if broken == "raise" else unread)
    )
    lost = F.when(F.coalesce(kind, F.lit("")).isin("Feature", "FeatureCollection"), None).otherwise(F.col("line"))
    rows = parsed.select(lost.alias("broken"), F.explode(features).alias("f")).select("broken", "f.*")
    return _geometry_columns(rows, [] if broken == "raise" else ["broken"])


# text before the first brace outside strings
_SKIP = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Texts up to each closing brace, written once, with what it takes to follow braces and strings across them.

    Of a chunk it matters whether it starts inside a string, and that is known only after all text before it. So each is
    counted both ways (``step0`` from outside, ``step1`` from inside a string), and so are sums within a block of the file.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")

    def outside(start: str) -> Column:
        return F.regexp_replace(F.concat(F.lit(start), bare), r'"[^"]*+("|\z)', "")

    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))

    def opened(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))

    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", quotes.alias("quotes"),
        (opened(outside("")) - (1 - quotes % 2)).alias("step0"), (opened(outside('"')) - quotes % 2).alias("step1"),
    )
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    sums = read.withColumn("odd", odd)
    for start in (0, 1):
        step = F.when(F.col("odd") == start, F.col("step0")).otherwise(F.col("step1"))
        sums = sums.withColumn(f"depth{start}", F.coalesce(F.sum(step).over(before), F.lit(0)))
    return materialize(sums, "geojson-chunks")


def _features(chunks: DataFrame) -> DataFrame:
    """Chunks put together up to each brace that leaves at most a collection open: ``text``, ``start``, ``closed``."""
    blocks = chunks.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("odd"),
        *[F.sum(F.when(F.col("odd") == s, F.col("step0")).otherwise(F.col("step1"))).alias(f"d{s}") for s in (0, 1)],
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    depth = F.sum(F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))).over(earlier)
    begun = begun.select("file", "block", "inside", F.coalesce(depth, F.lit(0)).alias("base"))

    string = (F.col("inside") + F.col("odd")) % 2
    start = F.col("base") + F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    step = F.when(string == 0, F.col("step0")).otherwise(F.col("step1"))
    closed = ((string + F.col("quotes")) % 2 == 0) & (start + step <= 1)
    placed = chunks.join(begun, ["file", "block"]).select("file", "block", "at", "value", start.alias("start"), closed.alias("closed"))
    ends = placed.groupBy("file", "block").agg(F.count_if("closed").alias("n"))
    ends = ends.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("first") + F.coalesce(F.sum(F.col("closed").cast("long")).over(before), F.lit(0))
    numbered = placed.join(ends, ["file", "block"]).withColumn("feature", number)
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value", "start")))
    return numbered.groupBy("file", "feature").agg(parts.alias("p"), F.max("closed").alias("closed")).select(
        F.concat(F.array_join("p.value", "}"), F.lit("}")).alias("text"), F.col("p")[0]["start"].alias("start"), "closed"
    )


def read_geojson_document(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of FeatureCollections that are JSON documents over any number of lines, one or more to a file.

    A document is read in as many tasks as its size asks for: the text is split at closing braces, and prefix sums over
    chunks, then over blocks of the file, tell which of them end a feature. No task or group holds more than a block or one
    feature. Braces and quotes in strings are told apart. Objects beside the features (``crs``) are passed over; a document
    that ends inside a feature, or a feature that cannot be read, fails the query. An empty file has no features.
    """
    feature = _FEATURE.format(props=f"struct<{properties}>")
    found = _features(_chunks(spark, path)).filter(F.col("start").isin(0, 1))
    lead = F.when(F.col("start") == 1, F.regexp_replace("text", f"(?s)^{_SKIP}", "")).otherwise(
        F.regexp_replace("text", rf"(?s)^{_SKIP}(\{{{_SKIP})?", "")
    )
    objects = found.select(lead.alias("text"), "closed").filter(F.startswith("text", F.lit("{")))
    parsed = objects.select("text", "closed", F.from_json("text", feature).alias("f"))
    broken = ~F.col("closed") | (F.col("f.type").isNull() & F.col("text").contains('"Feature"'))
    wrong = F.raise_error(F.concat(F.lit("not a whole GeoJSON feature: "), F.substring("text", 1, 200)))
    return _geometry_columns(parsed.filter(F.when(broken, wrong.cast("boolean")).otherwise(F.col("f.type") == "Feature")).select("f.*"))


def feature_json(df: DataFrame, geometry: str, kind: str, properties: list[str]) -> Column:
    """One GeoJSON feature per row as text; NULL attributes are written as null."""

    def coords(c: Column, depth: int) -> Column:
        if depth == 0:
            return F.array(c["x"], c["y"])
        return F.transform(c, lambda p: coords(p, depth - 1))

    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit(kind).alias("type"), coords(F.col(geometry), DEPTH[kind]).alias("coordinates")).alias(
                "geometry"
            ),
            F.struct(*properties).alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )


def write_features(
    df: DataFrame, path: str, geometry: str, kind: str, properties: list[str], mode: str = "errorifexists"
) -> None:
    """Text files with one feature per line."""
    df.select(feature_json(df, geometry, kind, properties).alias("value")).write.mode(mode).text(path)
