"""Motor carriers by ZIP area and carbon intensity by fuel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import in_set, lenient_sum, number, strict_sum
from ..functions.scalar import prefix, suffix
from ..operators.aggregates import count_by, density
from ..operators.ranking import row_id
from ..operators.relational import clean_names, left_on, natural_join
from ..session import materialize

# The home state with its neighbours, and fuels left out of the comparison.
STATES = ("MN", "ND", "SD", "IA", "WI")
BASE_FUELS = ("CARBOB", "Diesel", "FT Diesel")


def address_mismatch(census: DataFrame, state: str) -> DataFrame:
    """Carriers with different physical and mailing states, one of them ``state``."""
    return census.filter(
        (F.col("PHY_STATE") != F.col("MAILING_STATE")) & ((F.col("PHY_STATE") == state) | (F.col("MAILING_STATE") == state))
    )


def screen_carriers(
    census: DataFrame, states: Sequence[str] = STATES, min_yy: int = 19, max_yy: int = 23, max_ratio: int = 10
) -> DataFrame:
    """Property carriers of the region with a recent filing and a plausible driver to truck ratio."""
    yy = suffix("MCS150_DATE", 2).try_cast("int")
    trucks, drivers = F.col("NBR_POWER_UNIT"), F.col("DRIVER_TOTAL")
    return census.filter(
        in_set("PHY_STATE", *states)
        & (F.col("PC_FLAG") == "N")
        & (F.col("PRIVATE_PASSENGER_BUSINESS") == "N")
        & (F.col("PRIVATE_PASSENGER_NONBUSINESS") == "N")
        & yy.between(min_yy, max_yy)
        & (trucks > 0) & (drivers > 0)
        & (drivers < max_ratio * trucks) & (trucks < max_ratio * drivers)
    )


def carriers_by_state(screened: DataFrame) -> DataFrame:
    """Carriers and trucks per state, with a label."""
    return count_by(screened, "PHY_STATE", measures=[strict_sum("NBR_POWER_UNIT").alias("trucks")])


def job_carriers(screened: DataFrame, zips: DataFrame) -> DataFrame:
    """Trucks and mileage per ZIP area; areas without carriers stay with NULLs."""
    totals = screened.groupBy(prefix("PHY_ZIP", 5).alias("ZCTA5CE10")).agg(
        strict_sum("NBR_POWER_UNIT").alias("trucks"), lenient_sum("MCS150_MILEAGE").alias("mileage")
    )
    return natural_join(totals, zips.select("ZCTA5CE10"), "right")


def job_carbon_density(
    pathways: DataFrame, lo: float = -400.0, hi: float = 200.0, n: int = 512, bins: int = 1024,
    leave_out: Sequence[str] = BASE_FUELS,
) -> DataFrame:
    """Density of carbon intensity per fuel with the fuel's label and place, most pathways first."""
    kept = clean_names(pathways).filter(~in_set("fuel_category", *leave_out)).select(
        "fuel_category", number("current_certified_ci").alias("ci")
    )
    counts = materialize(count_by(kept, "fuel_category").withColumnRenamed("label", "chart_name"), "fuel-counts")
    order = row_id(counts, [-F.col("n"), "fuel_category"], "chart_order")
    curves = density(kept, "ci", "fuel_category", lo, hi, n, bins)
    return left_on(curves, order, {"fuel_category": "fuel_category"})
