"""Truck shares, segment delay, bottlenecks and network zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.nulls import number, ratio
from ..functions.scalar import wrap_degrees
from ..operators import spatial as P
from ..operators.aggregates import weighted_mean
from ..operators.ranking import percent_rank_global
from ..operators.relational import append, clean_names, filter_above_quantile, left_on, natural_join
from ..session import materialize
from ..sources.payloads import number_batches, payloads

# The day type and day part rows the delay index is taken from.
DAY_TYPE = "1: Weekdays (M-Th)"
DAY_PART = "0: All Day (12am-12am)"


def truck_segments(all_traffic: DataFrame, trucks: DataFrame) -> DataFrame:
    """Truck segments with all traffic beside them and the truck share."""
    adt = all_traffic.select("SEQUENCE_N", F.col("CURRENT_VO").alias("adt"))
    joined = natural_join(trucks, adt).withColumn("trucks", F.col("CURRENT_VO"))
    return joined.withColumn("truckP", ratio("trucks", "adt"))


def job_truck_share(all_traffic: DataFrame, trucks: DataFrame) -> DataFrame:
    """Mean trucks and mean truck share per route."""
    return truck_segments(all_traffic, trucks).groupBy("ROUTE_LABE").agg(
        F.avg("trucks").alias("avgTrucks"), F.avg("truckP").alias("avgTruckP")
    )


def segment_flow(results: DataFrame, day_type: str = DAY_TYPE, day_part: str = DAY_PART) -> DataFrame:
    """Text results per zone and vehicle weight to one row per zone, weights combined by volume."""
    rows = clean_names(results).filter((F.col("day_type") == day_type) & (F.col("day_part") == day_part)).select(
        "zone_id",
        number("average_daily_segment_traffic_st_l_index").alias("stlIndex"),
        number("avg_segment_speed_mph").alias("avgSpd"),
        number("free_flow_factor").alias("FFF"),
    )
    zones = materialize(weighted_mean(rows, ["zone_id"], "stlIndex", skip=["avgSpd"], strict=["FFF"]), "zone-flow")
    ranked = percent_rank_global(zones, "stlIndex", "percRank")
    return ranked.withColumn("zone_id", number("zone_id", "bigint")).filter(
        (F.col("FFF") > 0) & (F.col("stlIndex") >= 0)
    )


def job_segment_delay(
    results: DataFrame, zones: DataFrame, line: str = "line", src: int = 4326, dst: int = 6501, **kept_rows: str
) -> DataFrame:
    """Flow per zone with the zone's name and length in feet and the delay index (1 - FFF) * volume."""
    lengths = zones.select("id", "name", G.length(G.project(line, src, dst)).alias("lengthFeet"))
    flow = segment_flow(results, **kept_rows)
    return left_on(flow, lengths, {"zone_id": "id"}).withColumn(
        "delay_index", (1 - F.col("FFF")) * F.col("stlIndex")
    )


def job_bottlenecks(delay: DataFrame, max_flow: float = 0.8) -> DataFrame:
    """Busy zones (volume above the median) that flow badly, worst first."""
    delay = materialize(delay, "delay")
    busy = filter_above_quantile(delay, "stlIndex", 0.5)
    return (
        busy.filter(F.col("FFF") < max_flow).select("zone_id", "stlIndex", "avgSpd", "FFF", "name", "lengthFeet")
        .orderBy("FFF", "zone_id")
    )


def delay_hotspots(delay: DataFrame, p: float = 0.9) -> DataFrame:
    """Zones whose delay index is above its p-quantile."""
    return filter_above_quantile(materialize(delay, "delay"), "delay_index", p)


# ---- network -------------------------------------------------------------------------------------------


def freight_network(
    to_clip: Mapping[str, DataFrame], whole: Mapping[str, DataFrame], boundary: DataFrame, cell: float | None = None
) -> DataFrame:
    """All layers (``line_id``, ``line``) as one segment table with a ``source`` tag.

    The first group of layers is cut to the boundary areas (``area_id``, ``rings``), the second is taken as is.
    """
    parts = {}
    for tag, layer in to_clip.items():
        clipped = P.clip_lines(layer.select("line_id", "line"), "line", "line_id", boundary, "rings", "area_id", cell)
        parts[tag] = P.segments(clipped.select("line_id", F.explode("lines").alias("line")), "line", ["line_id"])
    for tag, layer in whole.items():
        parts[tag] = P.segments(layer, "line", ["line_id"])
    return append(parts, "source")


def job_network_lines(lines: DataFrame, network: DataFrame, d: float = 100.0, key: str = "zone_name") -> DataFrame:
    """Lines all of whose vertices lie within ``d`` of the network; rows sharing a key pass together."""
    pts = P.vertices(lines, "line", [key])
    off = P.beyond_distance(pts, network, d).select(F.col(key).alias("__off")).distinct()
    return lines.join(off, F.col(key).eqNullSafe(F.col("__off")), "left_anti")


def job_zone_batches(
    lines: DataFrame, name: str, size: int = 1000, min_metres: float = 100.0, order: Sequence[str] = ("zone_name",)
) -> DataFrame:
    """Lon/lat lines longer than ``min_metres`` as numbered pass-through zones in batches."""
    measured = lines.withColumns(
        {"direction": wrap_degrees(G.bearing("line")), "len_metres": G.length("line", geodesic=True)}
    ).filter(F.col("len_metres") > min_metres)
    zones = measured.select(*dict.fromkeys([*order, "zone_name", "line", "direction", "len_metres"]))
    # names may repeat, so the place in the written table decides among equals
    numbered = number_batches(materialize(zones, "zones", "__row"), size, [*order, "__row"], name)
    return numbered.select(
        "row_num", F.col("row_num").alias("id"), F.col("zone_name").alias("name"), F.lit(1).alias("is_pass"),
        "direction", "len_metres", "line", "batch", "batch_name",
    )


def zone_requests(zones: DataFrame) -> DataFrame:
    """One request body per batch of numbered zones, each zone as a line feature."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("LineString").alias("type"),
            F.transform("line", lambda p: F.array(p["x"], p["y"])).alias("coordinates"),
        ).alias("geometry"),
        F.struct("id", "name", "is_pass").alias("properties"),
    )
    return payloads(zones, feature, {"geom_type": "line"})


def job_split_zones(
    lines: DataFrame, network: DataFrame, name: str, d: float = 200.0,
    min_len: float = 400.0, max_len: float = 1320.0, size: int = 1000,
) -> DataFrame:
    """Lines (``segment_id``, ``line``) on the network cut into zones of at most ``max_len``, numbered in batches."""
    on_network = P.lines_within(lines, "line", "segment_id", network, d)
    long_enough = on_network.filter(G.length("line") > min_len)
    parts = materialize(P.split_lines(long_enough, "line", ["segment_id"], max_len), "zone-parts", "__row")
    numbered = number_batches(parts, size, ["segment_id", "part", "__row"], name)
    return numbered.select(
        "row_num", F.col("row_num").alias("id"),
        F.concat(F.col("segment_id").cast("string"), F.lit("_"), F.col("row_num").cast("string")).alias("name"),
        F.lit(1).alias("is_pass"), "segment_id", "part", "n_parts", "line", "batch", "batch_name",
    )
