"""Demographic profiles and population change across changed boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import codes as C
from ..functions.geometry import inner_point, whole_area
from ..functions.nulls import ratio, row_sum, strict_sum
from ..functions.scalar import change, pct_change, to_sqmi
from ..operators.relational import apply_overrides, left_on
from ..operators.reshape import pivot_values
from ..operators.skew import beside
from ..operators.spatial import spatial_join

# Each group as the variables added up for it; the first entry of a block is its denominator.
TOTAL_BASED = {
    "age65over": C.ACS_AGE65,
    "whiteNH": ("B03002_003",),
    "black": ("B03002_004", "B03002_014"),
    "amInd": ("B03002_005", "B03002_015"),
    "asian": ("B03002_006", "B03002_016"),
    "haPacIs": ("B03002_007", "B03002_017"),
    "Other": ("B03002_008", "B03002_018"),
    "twoOrMore": ("B03002_009", "B03002_019"),
    "hispLat": ("B03002_012",),
    "lowIncome": ("B17021_002",),
    "totForBorn": ("B05005_001",),
    "forBornE2010": ("B05005_004",),
}
WORKER_BASED = {
    "mttwAuto": "B08006_002", "mttwSOV": "B08006_003", "mttwTransit": "B08006_008", "mttwBike": "B08006_014",
    "mttwWalk": "B08006_015", "mttwOther": "B08006_016", "mttwWFH": "B08006_017",
}
DENOMINATORS = {
    "totPop": "B01001_001", "totFam": "B17026_001", "totPop5above": "B16004_001",
    "totCivNonInstPop": "B18101_001", "occHU": "B25044_001", "totWork16": "B08006_001",
}


def variables() -> list[str]:
    """All survey variables the profile needs."""
    groups = [v for members in TOTAL_BASED.values() for v in members]
    rest = [*C.ACS_POV185, *C.ACS_ENGLISH, *C.ACS_DISABLED, "B25044_003", "B25044_010", *WORKER_BASED.values()]
    return [*DENOMINATORS.values(), *groups, *rest]


def job_demographics(acs: DataFrame, areas: DataFrame, rings: str = "rings") -> DataFrame:
    """Tidy survey estimates (GEOID, variable, estimate) to group shares and density, one row per area.

    One geography per call: block group, tract, county subdivision and county tables have the same shape.
    """
    wide = pivot_values(acs, ["GEOID"], "variable", variables(), "estimate")
    total = {k: F.col(v) for k, v in DENOMINATORS.items()}
    share = {k: (row_sum(*v), "totPop") for k, v in TOTAL_BASED.items()}
    share["minority"] = (total["totPop"] - F.col("B03002_003"), "totPop")
    share["pov100"] = (row_sum(*C.ACS_POV100), "totFam")
    share["pov185"] = (row_sum(*C.ACS_POV185), "totFam")
    share["LEP"] = (total["totPop5above"] - row_sum(*C.ACS_ENGLISH), "totPop5above")
    share["disab"] = (row_sum(*C.ACS_DISABLED), "totCivNonInstPop")
    share["zeroVeh"] = (row_sum("B25044_003", "B25044_010"), "occHU")
    share.update({k: (F.col(v), "totWork16") for k, v in WORKER_BASED.items()})
    groups = wide.select(
        "GEOID",
        *[c.alias(k) for k, c in total.items()],
        *[F.round(ratio(c, total[base]), 4).alias(k) for k, (c, base) in share.items()],
    )
    sized = areas.select(F.col("GEOID"), F.round(to_sqmi(whole_area(areas, rings)), 2).alias("areaSM"))
    return left_on(groups, sized, {"GEOID": "GEOID"}).withColumn("popDensity", F.round(ratio("totPop", "areaSM"), 0))


def population_density(areas: DataFrame, rings: str = "rings") -> DataFrame:
    """People per square mile of areas that have an area."""
    return (
        areas.withColumn("areaSM", to_sqmi(whole_area(areas, rings))).drop(rings).filter(F.col("areaSM") > 0)
        .withColumn("popDensity", ratio("estimate", "areaSM"))
    )


def boundary_crosswalk(
    old: DataFrame, new: DataFrame, cell: float | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """New areas with the population of the old areas whose inner point they hold.

    ``old`` and ``new`` hold GEOID, estimate and rings; a new area without old points has no old population.
    """
    sound_old = old.filter(whole_area(old, "rings") > 0)
    sound_new = new.filter(whole_area(new, "rings") > 0)
    inner = sound_old.select(
        F.col("GEOID").alias("GEOID_old"), F.col("estimate").alias("pop_old"), inner_point(sound_old, "rings").alias("p")
    ).select("GEOID_old", "pop_old", "p.x", "p.y")
    targets = sound_new.select(F.col("GEOID").alias("GEOID_new"), F.col("estimate").alias("pop_new"), "rings")
    joined = spatial_join(targets, inner, "rings", "GEOID_new", cell)
    summed = joined.groupBy("GEOID_new").agg(
        strict_sum("pop_old").alias("pop_old"), F.max("pop_new").alias("pop_new")
    )
    return summed if overrides is None else apply_overrides(summed, overrides, "GEOID_new")


def job_population_change(
    old: DataFrame, new: DataFrame, cell: float | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """Old areas with the change of the new area of the same id."""
    walk = boundary_crosswalk(old, new, cell, overrides).withColumns(
        {"percChange": pct_change("pop_new", "pop_old"), "change": change("pop_new", "pop_old")}
    )
    sound_old = old.filter(whole_area(old, "rings") > 0).drop("rings")
    return left_on(sound_old, walk, {"GEOID": "GEOID_new"})


def total_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: both totals, their difference and their ratio."""
    out = beside(new.agg(strict_sum("estimate").alias("pop_new")), old.agg(strict_sum("estimate").alias("pop_old")))
    return out.withColumns({"change": change("pop_new", "pop_old"), "growth": ratio("pop_new", "pop_old")})
