"""Grade crossings, train volumes, track tables and crashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codes import RAIL_OWNERS
from ..functions import geometry as G
from ..functions.nulls import coalesce_max, in_set, number, row_sum, strict_sum
from ..functions.scalar import classify, to_miles, year_from_yy
from ..operators import spatial as P
from ..operators.aggregates import mode_by, with_total_row
from ..operators.relational import attach_labels, keep_in, left_on, split_null
from ..operators.reshape import pivot_counts, pivot_sums
from ..session import materialize

# Categories in table order.
TYPES = ("PubHwy", "PubPed", "Priv")
DEVICES = ("FourQuad", "GatesWithMedian", "Gates", "FlashingOnly", "StopSign", "Crossbuck", "Unknown")
NETS = ("M", "O", "I", "S", "Y")
NET_NAMES = {"M": "Mainline", "O": "Non-Mainline", "I": "Industry", "S": "Siding", "Y": "Yard"}
SEVERITIES = ("Fatal", "Injury", "PDO")


def owner_table(spark) -> DataFrame:
    return spark.createDataFrame(list(RAIL_OWNERS), "CrossingIdSuffix string, RRname string")


def job_crossings(
    inventory: DataFrame, areas: DataFrame, owners: DataFrame, cell: float | None = None, src: int = 4326, dst: int = 6501
) -> DataFrame:
    """Open at-grade crossings inside the study areas with type, warning device, quiet zone, owner and trains."""
    c = F.col
    no_gates = (c("Gates") == 0) & (c("FlashPai") == 0)
    kind = [
        ((c("TypeXing") == 3) & (c("XPurpose") == 1), "PubHwy"),
        (c("TypeXing") == 2, "Priv"),
        ((c("TypeXing") == 3) & (c("XPurpose") > 1), "PubPed"),
    ]
    device = [
        (c("GateConf") == 3, "FourQuad"),
        ((c("Gates") > 0) & in_set("Channel", 1, 2, 3, 4), "GatesWithMedian"),
        (c("Gates") > 0, "Gates"),
        ((c("FlashPai") > 0) & (c("Gates") == 0), "FlashingOnly"),
        (no_gates & (c("StopStd") > 0), "StopSign"),
        (no_gates & (c("StopStd") == 0) & (c("XBuck") > 0), "Crossbuck"),
    ]
    quiet = [
        (c("Whistban") == 1, "QZ"),
        (c("Whistban") == 0, "Horns Sound"),
        (c("Whistban").isNull(), "Horns Sound"),
    ]
    located = (
        inventory.filter((c("PosXing") == 1) & (c("ReasonID") != 16) & c("Latitude").isNotNull())
        .withColumns({"Type": classify(kind), "WarnDev": classify(device, "Unknown"), "QZ": classify(quiet)})
        .withColumn("__p", G.project(G.point("Longitude", "Latitude"), src, dst, 0))
        .select("*", "__p.x", "__p.y").drop("__p")
    )
    inside = P.points_in_area(located, areas, "rings", cell)
    return attach_labels(inside, owners, "CrossingIdSuffix").withColumn("trainTot", c("DayThru") + c("NghtThru"))


def job_rail_volume(crossings: DataFrame, rail: DataFrame, net: str = "M") -> DataFrame:
    """Trains and speed per mainline: the mode over its nearest crossings, else those of the nearest known line."""
    segs = P.segments(rail, "line", ["OBJECTID"])
    nearest = P.nearest_join(P.point_segments(crossings, ["CrossingID"]), segs, ["CrossingID"], "OBJECTID").drop("distance")
    observed = materialize(
        left_on(crossings.select("CrossingID", "trainTot", "MaxTtSpd"), nearest, {"CrossingID": "CrossingID"}).drop("CrossingID")
    )
    modes = mode_by(observed, ["OBJECTID"], ["trainTot", "MaxTtSpd"]).withColumnsRenamed(
        {"trainTot": "trains", "MaxTtSpd": "speed"}
    )
    mainlines = rail.filter(in_set("NET", net)).select("OBJECTID", "line")
    joined = materialize(left_on(mainlines, modes, {"OBJECTID": "OBJECTID"}))
    known, empty = split_null(joined, "trains")
    known_segs = P.segments(known, "line", ["OBJECTID"]).withColumnRenamed("OBJECTID", "known_id")
    found = P.nearest_join(P.segments(empty, "line", ["OBJECTID"]), known_segs, ["OBJECTID"], "known_id").drop("distance")
    filled = left_on(
        found,
        known.select(F.col("OBJECTID").alias("known_id"), F.col("trains").alias("trains_y"), F.col("speed").alias("speed_y")),
        {"known_id": "known_id"},
    ).drop("known_id")
    both = left_on(joined.select("OBJECTID", "trains", "speed"), filled, {"OBJECTID": "OBJECTID"})
    return both.select(
        "OBJECTID", coalesce_max("trains", "trains_y").alias("trains"), coalesce_max("speed", "speed_y").alias("speed")
    )


def job_crossing_table(crossings: DataFrame) -> DataFrame:
    """Crossings per railroad by type, with a total."""
    counts = pivot_counts(crossings, ["RRname"], "Type", TYPES)
    return counts.select(
        F.col("RRname").alias("Railroad"),
        F.col("PubHwy").alias("Public Highway Crossing"),
        F.col("PubPed").alias("Public Pedestrian Crossing"),
        F.col("Priv").alias("Private"),
        row_sum(*TYPES).alias("Total Grade Crossings"),
    )


def job_track_table(rail: DataFrame, crossing_table: DataFrame) -> DataFrame:
    """Track miles per owner and network class beside its crossings, most miles first and a grand total row last."""
    measured = rail.filter(F.col("RROWNER1").isNotNull()).select("RROWNER1", "NET", G.whole_length(rail, "line").alias("feet"))
    miles = measured.groupBy("RROWNER1", "NET").agg(F.round(to_miles(strict_sum("feet")), 0).alias("miles"))
    wide = pivot_sums(miles, ["RROWNER1"], "NET", NETS, F.col("miles"))
    named = wide.select(
        F.col("RROWNER1").alias("Railroad"),
        *[F.col(k).cast("double").alias(v) for k, v in NET_NAMES.items()],
        row_sum(*NETS).cast("double").alias("Total Miles"),
    )
    joined = left_on(named, crossing_table, {"Railroad": "Railroad"})
    totals = with_total_row(joined, "Railroad", [c for c in joined.columns if c != "Railroad"])
    return totals.orderBy(F.col("Railroad").isNull(), F.desc("Total Miles"), "Railroad")


def job_warning_table(crossings: DataFrame) -> DataFrame:
    """Public crossings per railroad by warning device, most crossings first."""
    public = crossings.filter(in_set("Type", "PubHwy", "PubPed"))
    counts = pivot_counts(public, ["RRname"], "WarnDev", DEVICES).withColumn("Total", row_sum(*DEVICES))
    return counts.orderBy(F.desc("Total"), "RRname").select(
        F.col("RRname").alias("Railroad"),
        F.col("FourQuad").alias("Four Quadrant Gates"),
        F.col("GatesWithMedian").alias("Gates with Medians"),
        "Gates",
        F.col("FlashingOnly").alias("Flashing Lights Only"),
        F.col("StopSign").alias("Stop Sign"),
        "Crossbuck",
        "Unknown",
        "Total",
    )


def study_crashes(crashes: DataFrame, crossings: DataFrame) -> DataFrame:
    """Crashes at a crossing of the study areas, each once."""
    return keep_in(crashes, crossings, {"GXID": "CrossingID"})


def job_crash_severity(
    crashes: DataFrame, crossings: DataFrame, since: int = 2016, max_yy: int = 23, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Crossings that had crashes since a year, with the number of crashes by severity."""
    recent = (
        study_crashes(crashes, crossings)
        .withColumn("CrashYear", year_from_yy("YEAR", max_yy))
        .filter(F.col("CrashYear") >= since)
        .withColumn(
            "severity", classify([(number("TOTKLD") > 0, "Fatal"), (number("TOTINJ") > 0, "Injury")], "PDO")
        )
    )
    counts = pivot_counts(recent, ["GXID"], "severity", SEVERITIES).withColumn("TotalCrashes", row_sum(*SEVERITIES))
    return left_on(crossings.select("CrossingID", *keep), counts, {"CrossingID": "GXID"}, "inner")
