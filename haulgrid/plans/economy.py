"""Sector GDP, job counts, location quotients and establishments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes as C
from ..functions.geometry import whole_area
from ..functions.nulls import in_set, ratio, strict_sum
from ..functions.scalar import classify, flag_in, normalize_codes, percent_label, prefix, to_sqmi
from ..operators.aggregates import designated, share_of, sum_cols
from ..operators.ranking import impute_group_mean, order_rank, top_per_group
from ..operators.relational import append, attach_labels, attach_scalar, join_suffix, keep_in, left_on, to_number
from ..operators.reshape import totals_row, unpivot
from ..session import materialize

# ---- GDP -----------------------------------------------------------------------------------------------


def job_gdp_profile(
    gdp: DataFrame,
    labels: DataFrame,
    years: Sequence[str],
    places: Mapping[str, str],
    codes: Sequence[str] = C.GDP_CODES,
    freight: Sequence[str] = C.FREIGHT_CODES,
) -> DataFrame:
    """Wide GDP table to one row per place, sector and year; suppressed values become the sector's mean.

    ``places`` maps the place names to keep to their area label.
    """
    code = classify(
        [
            (F.col("Description") == "All industry total", "All"),
            (F.col("Description") == "Government and government enterprises", "Gov"),
        ]
    )
    kept = (
        gdp.withColumn("IndustryClassification", F.coalesce(code, F.col("IndustryClassification")))
        .filter(in_set("IndustryClassification", *codes) & in_set("GeoName", *places))
    )
    long = unpivot(
        to_number(kept, years),
        ["GeoFIPS", "GeoName", "IndustryClassification", "Description"], years, "Year", "Thousands",
    )
    filled = impute_group_mean(long, ["Description", "GeoFIPS"], "Thousands").withColumnRenamed("missing", "MissingData")
    flagged = filled.withColumns(
        {
            "FreightRel": in_set("IndustryClassification", *freight),
            "area": normalize_codes("GeoName", places),
        }
    )
    return attach_labels(flagged, labels, "IndustryClassification")


def _one_year(profile: DataFrame, year: str, place: str) -> DataFrame:
    return profile.filter((F.col("Year") == year) & (F.col("area") == place))


def _national(profile: DataFrame, year: str, nation: str) -> DataFrame:
    return (
        _one_year(profile, year, nation).groupBy("IndustryClassification", "shortname", "FreightRel")
        .agg(F.coalesce(F.sum("Thousands"), F.lit(0.0)).alias("Thousands"))
    )


def job_gdp_mix(profile: DataFrame, year: str, home: str, nation: str, total_label: str = "All Industry Total") -> DataFrame:
    """Sector shares of two areas side by side, those of the home area with a negative sign."""

    profile = materialize(profile.filter((F.col("Year") == year) & in_set("area", home, nation)), "gdp-year")

    def with_shares(df: DataFrame, place: str, sign: int) -> DataFrame:
        total = df.agg(designated(F.col("IndustryClassification") == "All", "Thousands").alias("totGDP"))
        out = attach_scalar(df, total)
        share = ratio("Thousands", "totGDP")
        return out.withColumns(
            {"percGDP": share * sign, "percGDPlabel": percent_label(share), "area": F.lit(place)}
        )

    cols = ["IndustryClassification", "shortname", "FreightRel", "Thousands"]
    both = append([
        with_shares(_one_year(profile, year, home).select(*cols), home, -1),
        with_shares(_national(profile, year, nation), nation, 1),
    ])
    return both.filter(F.col("shortname") != total_label)


def job_gdp_share(profile: DataFrame, year: str, home: str, nation: str) -> DataFrame:
    """Each home sector as a share of the same sector of the nation, largest first."""
    profile = materialize(profile.filter((F.col("Year") == year) & in_set("area", home, nation)), "gdp-year")
    mine = _one_year(profile, year, home).select(
        "IndustryClassification", "shortname", "FreightRel", F.col("Thousands").alias("totGDPhome")
    )
    joined = left_on(mine, _national(profile, year, nation).select("shortname", "Thousands"), {"shortname": "shortname"})
    share = ratio("totGDPhome", "Thousands")
    return joined.withColumns({"percUS": share, "label": F.round(share * 100, 1)}).orderBy(F.desc("percUS"), "shortname")


# ---- job counts ----------------------------------------------------------------------------------------


def _job_columns() -> dict[str, str]:
    return {sector: f"CNS{i:02d}" for i, sector in enumerate(C.JOB_SECTORS, start=1)}


def job_jobs_rollup(
    jobs: DataFrame, group_len: int = 12, area_len: int = 5,
    freight: Sequence[str] = C.FREIGHT_JOB_SECTORS, goods: Sequence[str] = C.GOODS_JOB_SECTORS,
) -> DataFrame:
    """Jobs per block summed to block groups, with freight and goods-producing totals and their shares."""
    cns = _job_columns()
    grouped = jobs.groupBy(prefix("w_geocode", group_len).alias("BG")).agg(
        F.count(F.lit(1)).alias("numBlocks"),
        strict_sum("C000").alias("NAICS_All"),
        *[strict_sum(c).alias(f"NAICS_{s}") for s, c in cns.items()],
        sum_cols([cns[s] for s in freight]).alias("FreightEmp"),
        sum_cols([cns[s] for s in goods]).alias("GoodsProdEmp"),
    )
    return grouped.withColumns(
        {
            "FreightProp": ratio("FreightEmp", "NAICS_All"),
            "GoodsProp": ratio("GoodsProdEmp", "NAICS_All"),
            "county_geoid": prefix("BG", area_len),
        }
    )


def job_job_density(rollup: DataFrame, areas: DataFrame, rings: str = "rings") -> DataFrame:
    """Every area with its job counts (0 where there are none) and freight jobs per square mile."""
    sized = areas.withColumn("sqmi", to_sqmi(whole_area(areas, rings))).drop(rings)
    joined = left_on(sized, rollup, {"GEOID": "BG"})
    counts = [c for c in rollup.columns if c not in ("BG", "county_geoid")]
    return joined.fillna(0, subset=counts).withColumns(
        {"FreightEmpDens": ratio("FreightEmp", "sqmi"), "FreightEmpProp": ratio("FreightEmp", "NAICS_All")}
    )


def job_lq_area(density: DataFrame) -> DataFrame:
    """Location quotient of every sector in every small area against all areas together."""
    sectors = [f"NAICS_{s}" for s in C.JOB_SECTORS] + ["FreightEmp", "GoodsProdEmp"]
    density = materialize(density, "job-density")
    both = attach_scalar(density, totals_row(density, sectors, "NAICS_All", "_all"))
    quotients = [ratio(ratio(s, "NAICS_All"), s + "_all").alias("LQ_" + s) for s in sectors]
    return both.select("GEOID", "FreightEmp", *quotients)


# ---- establishments ------------------------------------------------------------------------------------


def _coded(est: DataFrame) -> DataFrame:
    """Single-code sectors and numeric measures; keeps only the rows for all establishment sizes."""
    numbers = [c for c in ("EMP", "ESTAB", "PAYANN") if c in est.columns]
    return (
        to_number(est.filter(F.col("EMPSZES") == "001"), numbers)
        .withColumn("NAICS", normalize_codes("NAICS2017", C.RANGED_CODES))
        .withColumn("len", F.char_length("NAICS"))
    )


def job_establishments(
    est: DataFrame, counties: DataFrame, labels: DataFrame, freight: Sequence[str] = C.FREIGHT_CODES, max_len: int = 2
) -> DataFrame:
    """Employment, establishments and payroll per sector over the target counties (``state``, ``county``)."""
    kept = keep_in(_coded(est), counties, {"state": "state", "county": "county"}).filter(
        (F.col("len") <= max_len) & ~in_set("NAICS", "00", "99")
    )
    flagged = kept.withColumn("FreightRelated", flag_in("NAICS", freight, "Freight", "Non-Freight"))
    grouped = flagged.groupBy("NAICS", "YEAR", "FreightRelated").agg(
        strict_sum("EMP").alias("emp"), strict_sum("ESTAB").alias("estab"), strict_sum("PAYANN").alias("pay")
    )
    return left_on(grouped, labels, {"NAICS": "NAICS2"})


def establishments_by_kind(sectors: DataFrame) -> DataFrame:
    return sectors.groupBy("FreightRelated").agg(*[strict_sum(c).alias(c) for c in ("emp", "estab", "pay")])


def freight_share(sectors: DataFrame) -> DataFrame:
    return share_of(sectors, F.col("FreightRelated") == "Freight", "emp", ["YEAR"])


def job_lq_depth(
    region: DataFrame, nation: DataFrame, titles: DataFrame, depth: int, freight: Sequence[str] = C.FREIGHT_CODES
) -> DataFrame:
    """Location quotient per code of one length: regional share of employment over national share."""

    def with_total(df: DataFrame) -> DataFrame:
        kept = _coded(df).filter((F.col("NAICS") == "00") | (F.col("len") == depth))
        summed = materialize(kept.groupBy("NAICS").agg(strict_sum("EMP").alias("EMP")), "code-totals")
        return attach_scalar(summed, summed.agg(designated(F.col("NAICS") == "00", "EMP").alias("denom")))

    mine = with_total(region).filter(~in_set("NAICS", "00", "99"))
    both = join_suffix(mine, with_total(nation), ["NAICS"])
    return left_on(both, titles, {"NAICS": "Code"}).withColumns(
        {
            "LQ": ratio(ratio("EMP_x", "denom_x"), ratio("EMP_y", "denom_y")),
            "FreightRel": flag_in("NAICS", freight, "Freight", "Non-Freight", prefix_len=2),
        }
    )


def job_lq_rollup(
    est: DataFrame, in_region: Column, titles: DataFrame, depth: int, freight: Sequence[str] = C.FREIGHT_CODES
) -> DataFrame:
    """``job_lq_depth`` of a region within the table it is part of, in one pass.

    Region and whole are conditional sums of one aggregation by code; the totals ("00") are two of its rows.
    """
    here, known = F.coalesce(in_region, F.lit(False)), F.col("EMP").isNotNull()
    kept = _coded(est).filter((F.col("NAICS") == "00") | (F.col("len") == depth))
    summed = materialize(
        kept.groupBy("NAICS").agg(
            F.when(F.count_if(here & ~known) == 0, F.sum(F.when(here, F.col("EMP")))).alias("EMP_x"),
            strict_sum("EMP").alias("EMP_y"), F.count_if(here).alias("__here"),
        ), "code-totals",
    )
    total = F.col("NAICS") == "00"
    both = attach_scalar(summed, summed.agg(designated(total, "EMP_x").alias("denom_x"), designated(total, "EMP_y").alias("denom_y")))
    mine = both.filter((F.col("__here") > 0) & ~in_set("NAICS", "00", "99")).drop("__here")
    return left_on(mine, titles, {"NAICS": "Code"}).withColumns(
        {
            "LQ": ratio(ratio("EMP_x", "denom_x"), ratio("EMP_y", "denom_y")),
            "FreightRel": flag_in("NAICS", freight, "Freight", "Non-Freight", prefix_len=2),
        }
    )


def top_quotients(lq: DataFrame, k: int = 10) -> DataFrame:
    return lq.filter(F.col("FreightRel") == "Freight").orderBy(F.desc("LQ"), "NAICS").limit(k)


def sub_sectors(est: DataFrame, titles: DataFrame, depth: int = 4) -> DataFrame:
    """Employment of every code of one length beside its two-digit sector."""
    kept = _coded(est).filter(F.col("len") == depth)
    summed = kept.groupBy(prefix("NAICS", 2).alias("NAICS2"), "NAICS").agg(strict_sum("EMP").alias("empTot"))
    return left_on(summed, titles, {"NAICS": "Code"})


def sub_sector_order(totals: DataFrame) -> DataFrame:
    """Chart order of the codes, largest employment first."""
    return order_rank(totals, "NAICS", F.max("empTot"))


def job_sector_leader(est: DataFrame, titles: DataFrame, counties: DataFrame, depth: int = 4) -> DataFrame:
    """For every two-digit sector the county detail of its largest sub-sector, all sectors in one job."""
    leaders = top_per_group(
        sub_sectors(est, titles, depth), ["NAICS2"], [F.desc_nulls_last("empTot"), F.col("NAICS")]
    )
    detail = _coded(est).filter(F.col("len") == depth).select("NAICS", "state", "county", "EMP")
    joined = left_on(leaders, detail, {"NAICS": "NAICS"}, "inner")
    return left_on(joined, counties, {"state": "state", "county": "county"})
