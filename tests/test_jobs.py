"""End-to-end analyses on small literal tables: the intended behaviour where a naive reading goes wrong."""

import json
import math

import pytest
from pyspark.sql import functions as F

from haulgrid import codes as C
from haulgrid.operators import aggregates
from haulgrid.plans import carriers, economy, highway, population, rail


def test_gdp_profile_imputes_flags_and_labels(spark):
    gdp = spark.createDataFrame(
        [
            ("00000", "United States *", "...", "All industry total", "100", "200"),
            ("27000", "Minnesota", "...", "All industry total", "10", "(D)"),
            ("27000", "Minnesota", "31-33", "Manufacturing", "(D)", "(D)"),
            ("27000", "Minnesota", "99", "Other", "1", "1"),
            ("55000", "Wisconsin", "11", "Farming", "1", "1"),
        ],
        "GeoFIPS string, GeoName string, IndustryClassification string, Description string, `2020` string, `2021` string",
    )
    labels = spark.createDataFrame([(c, f"Sector {c}") for c in C.GDP_CODES], "IndustryClassification string, shortname string")
    out = economy.job_gdp_profile(gdp, labels, ["2020", "2021"], {"United States *": "US", "Minnesota": "MN"})
    got = {(r["area"], r["IndustryClassification"], r["Year"]): r for r in out.collect()}
    assert set(got) == {(a, c, y) for a, c in [("US", "All"), ("MN", "All"), ("MN", "31-33")] for y in ("2020", "2021")}
    imputed = got["MN", "All", "2021"]
    assert (imputed["Thousands"], imputed["MissingData"]) == (10.0, True)
    assert got["MN", "31-33", "2021"]["Thousands"] is None
    assert got["MN", "31-33", "2020"]["FreightRel"] and not got["US", "All", "2020"]["FreightRel"]
    assert got["MN", "31-33", "2020"]["shortname"] == "Sector 31-33"


def test_gdp_mix_mirrors_the_home_area(spark):
    rows = [("MN", "All", "All Industry Total", 100.0), ("MN", "11", "11: Agriculture", 25.0),
            ("US", "All", "All Industry Total", 1000.0), ("US", "11", "11: Agriculture", 100.0)]
    profile = spark.createDataFrame(
        [(a, c, s, True, "2021", t) for a, c, s, t in rows],
        "area string, IndustryClassification string, shortname string, FreightRel boolean, Year string, Thousands double",
    )
    got = {r["area"]: (r["percGDP"], r["percGDPlabel"]) for r in economy.job_gdp_mix(profile, "2021", "MN", "US").collect()}
    assert got == {"MN": (-0.25, "25.0%"), "US": (0.1, "10.0%")}
    share = {r["shortname"]: (r["percUS"], r["label"]) for r in economy.job_gdp_share(profile, "2021", "MN", "US").collect()}
    assert share == {"11: Agriculture": (0.25, 25.0), "All Industry Total": (0.1, 10.0)}


def jobs_row(geo, base):
    return (geo, base * 20, *[base] * 20)


JOBS = "w_geocode string, C000 int, " + ", ".join(f"CNS{i:02d} int" for i in range(1, 21))


def test_jobs_rollup_and_quotients(spark):
    jobs = spark.createDataFrame([jobs_row("270010001001001", 1), jobs_row("270010001001002", 2), jobs_row("010010001002001", 0)], JOBS)
    roll = {r["BG"]: r for r in economy.job_jobs_rollup(jobs).collect()}
    one = roll["270010001001"]
    assert (one["numBlocks"], one["NAICS_All"], one["FreightEmp"], one["GoodsProdEmp"], one["county_geoid"]) == (2, 60, 24, 12, "27001")
    assert one["FreightProp"] == pytest.approx(0.4)
    assert roll["010010001002"]["FreightProp"] is None
    side = 5280.0
    square = [[(0.0, 0.0), (side, 0.0), (side, side), (0.0, side), (0.0, 0.0)]]
    areas = spark.createDataFrame(
        [("270010001001", square), ("999999999999", square)], "GEOID string, rings array<array<struct<x:double,y:double>>>"
    )
    dens = {r["GEOID"]: r for r in economy.job_job_density(economy.job_jobs_rollup(jobs), areas).collect()}
    assert dens["270010001001"]["FreightEmpDens"] == pytest.approx(24)
    assert dens["999999999999"]["NAICS_All"] == 0 and dens["999999999999"]["FreightEmpProp"] is None
    lq = {r["GEOID"]: r for r in economy.job_lq_area(economy.job_job_density(economy.job_jobs_rollup(jobs), areas)).collect()}
    # one area holds all jobs, so it is the reference area itself
    assert lq["270010001001"]["LQ_NAICS_48"] == pytest.approx(1) and lq["999999999999"]["LQ_NAICS_48"] is None


EST = "state string, county string, EMP string, EMPSZES string, ESTAB string, NAICS2017 string, YEAR string, PAYANN string"
EST_ROWS = [
    ("27", "001", "100", "001", "5", "00", "2021", "9"),
    ("27", "001", "40", "001", "2", "31-33", "2021", "(D)"),
    ("27", "001", "7", "210", "2", "31-33", "2021", "1"),
    ("27", "003", "60", "001", "3", "31-33", "2021", "5"),
    ("27", "003", "20", "001", "1", "52", "2021", "5"),
    ("27", "003", "3", "001", "1", "99", "2021", "5"),
    ("55", "001", "500", "001", "9", "52", "2021", "5"),
    ("27", "001", "30", "001", "1", "3111", "2021", "5"),
    ("27", "003", "50", "001", "1", "3112", "2021", "5"),
    ("27", "001", "10", "001", "1", "3112", "2021", "5"),
]


def test_establishments_match_state_and_county(spark):
    est = spark.createDataFrame(EST_ROWS, EST)
    counties = spark.createDataFrame([("27", "001"), ("27", "003")], "state string, county string")
    labels = spark.createDataFrame([("Manufacturing", "31")], "shortname string, NAICS2 string")
    sectors = economy.job_establishments(est, counties, labels)
    got = {r["NAICS"]: (r["emp"], r["pay"], r["FreightRelated"], r["shortname"]) for r in sectors.collect()}
    assert got == {"31": (100.0, None, "Freight", "Manufacturing"), "52": (20.0, 5.0, "Non-Freight", None)}
    assert economy.freight_share(sectors).first()["share"] == pytest.approx(100 / 120)


def test_sector_leader_gives_county_detail(spark):
    est = spark.createDataFrame(EST_ROWS, EST).filter(F.col("state") == "27")
    titles = spark.createDataFrame([("3112", "Milling")], "Code string, Title string")
    counties = spark.createDataFrame([("27", "001", "A"), ("27", "003", "B")], "state string, county string, NAME string")
    rows = economy.job_sector_leader(est, titles, counties).collect()
    assert sorted((r["NAICS2"], r["NAICS"], r["Title"], r["NAME"], r["EMP"]) for r in rows) == [
        ("31", "3112", "Milling", "A", 10.0), ("31", "3112", "Milling", "B", 50.0)
    ]


def test_nation_against_itself_has_quotient_one(spark):
    est = spark.createDataFrame(EST_ROWS, EST).filter(F.col("state") == "27")
    titles = spark.createDataFrame([("31", "Manufacturing")], "Code string, Title string")
    lq = economy.job_lq_depth(est, est, titles, 2)
    got = {r["NAICS"]: (r["LQ"], r["FreightRel"], r["Title"]) for r in lq.collect()}
    assert got["31"] == (pytest.approx(1), "Freight", "Manufacturing")
    assert set(got) == {"31", "52"}
    assert [r["NAICS"] for r in economy.top_quotients(lq).collect()] == ["31"]


def test_rollup_equals_two_tables(spark):
    est = spark.createDataFrame(EST_ROWS, EST)
    titles = spark.createDataFrame([("31", "Manufacturing")], "Code string, Title string")
    here = F.col("state") == "27"
    for depth in (2, 4):
        apart = economy.job_lq_depth(est.filter(here), est, titles, depth)
        rolled = economy.job_lq_rollup(est, here, titles, depth)
        columns = ["NAICS", "EMP_x", "denom_x", "EMP_y", "denom_y", "LQ", "Title", "FreightRel"]
        assert sorted(map(tuple, rolled.select(columns).collect()), key=str) == sorted(map(tuple, apart.select(columns).collect()), key=str)
        assert rolled.count() > 0


def test_density_of_few_copies_and_edges(spark):
    """Against numpy, node by node: copies, both edges, a category of one value, a missing category."""
    import numpy as np

    rnd = np.random.default_rng(3)
    rows = [("a", float(v)) for v in [*rnd.uniform(0, 10, 300), *[2.5] * 200, 0.0, 10.0, 10.0, 11.0, -1.0]]
    rows += [("b", 4.0)] * 3 + [(None, v) for v in (1.0, 2.0, 7.0)] + [("a", None)]
    df = spark.createDataFrame(rows, "c string, v double").repartition(3)
    got = {}
    for r in aggregates.density(df, "v", "c", 0.0, 10.0, n=32, bins=64).collect():
        got.setdefault(r["c"], []).append((r["x"], r["density"]))
    assert set(got) == {"a", "b", None}
    for c, points in got.items():
        x = np.array([v for k, v in rows if k == c and v is not None and 0 <= v <= 10])
        q1, q3 = np.quantile(x, [0.25, 0.75])
        sd = x.std(ddof=1)
        low = min(sd, (q3 - q1) / 1.34) or sd or abs(x).max()
        h = 0.9 * low * len(x) ** -0.2
        step = 10 / 64
        left = np.minimum(np.floor(x / step), 63)
        part = x / step - left
        for at, d in points:
            near = (1 - part) * np.exp(-0.5 * ((at - left * step) / h) ** 2) + part * np.exp(-0.5 * ((at - (left + 1) * step) / h) ** 2)
            assert d == pytest.approx(near.sum() / (len(x) * h * np.sqrt(2 * np.pi)), rel=1e-9, abs=1e-300)


def test_demographics_groups_and_zero_denominators(spark):
    rows = [("a", v, 10.0) for v in population.variables()] + [("b", v, 0.0) for v in population.variables()]
    rows += [("c", v, 5.0) for v in population.variables() if v != "B01001_020"]
    acs = spark.createDataFrame(rows, "GEOID string, variable string, estimate double")
    side = 5280.0 * 2
    square = [[(0.0, 0.0), (side, 0.0), (side, side), (0.0, side), (0.0, 0.0)]]
    areas = spark.createDataFrame([(g, square) for g in "abc"], "GEOID string, rings array<array<struct<x:double,y:double>>>")
    got = {r["GEOID"]: r for r in population.job_demographics(acs, areas).collect()}
    a = got["a"]
    assert (a["totPop"], a["age65over"], a["minority"], a["black"], a["pov100"], a["pov185"]) == (10.0, 12.0, 0.0, 2.0, 3.0, 7.0)
    assert (a["LEP"], a["disab"], a["zeroVeh"], a["mttwWFH"]) == (-14.0, 12.0, 2.0, 1.0)
    assert (a["areaSM"], a["popDensity"]) == (4.0, 3.0)
    assert got["b"]["age65over"] is None
    assert got["c"]["age65over"] is None and got["c"]["black"] == 2.0


def test_truck_share_is_derived_before_it_is_averaged(spark):
    adt = spark.createDataFrame([(1, 100.0), (2, 0.0)], "SEQUENCE_N int, CURRENT_VO double")
    trucks = spark.createDataFrame([(1, "I 94", 10.0), (2, "I 94", 30.0), (3, "I 94", None)], "SEQUENCE_N int, ROUTE_LABE string, CURRENT_VO double")
    # a shared measure name must not become a join key
    assert tuple(highway.job_truck_share(adt, trucks).first()) == ("I 94", 20.0, 0.1)


def results(spark, rows):
    raw = ["Zone ID", "Vehicle Weight", "Day Type", "Day Part", "Average Daily Segment Traffic (StL Index)", "Avg Segment Speed (mph)", "Free Flow Factor"]
    return spark.createDataFrame([(z, w, highway.DAY_TYPE, highway.DAY_PART, i, s, f) for z, w, i, s, f in rows], ", ".join(f"`{c}` string" for c in raw))


def test_segment_flow_missing_speed_and_factor(spark):
    df = results(spark, [
        ("1", "Heavy", "30", "40", "0.5"), ("1", "Medium", "10", "NA", "0.9"),
        ("2", "Heavy", "30", "40", "0.5"), ("2", "Medium", "10", "50", "NA"),
        ("3", "Heavy", "0", "40", "0.5"), ("4", "Heavy", "5", "60", "1.0"),
    ])
    got = {r["zone_id"]: (r["stlIndex"], r["avgSpd"], r["FFF"], r["percRank"]) for r in highway.segment_flow(df).collect()}
    assert set(got) == {1, 4}
    assert got[1] == (40.0, pytest.approx(30.0), pytest.approx(0.6), pytest.approx(2 / 3))
    assert got[4][3] == pytest.approx(1 / 3)


def test_delay_and_bottlenecks(spark):
    df = results(spark, [(str(i), "Heavy", str(10 * i), "40", str(0.5 + 0.1 * (i % 5))) for i in range(1, 9)])
    zones = spark.createDataFrame([(i, f"r{i}", [(-94.0, 45.0), (-94.0, 45.01)]) for i in range(1, 9)], "id int, name string, line array<struct<x:double,y:double>>")
    delay = highway.job_segment_delay(df, zones)
    row = delay.filter("zone_id = 6").first()
    assert row["delay_index"] == pytest.approx(0.4 * 60) and row["name"] == "r6"
    # 0.01 degrees of latitude is about 1,111.4 m here
    assert row["lengthFeet"] == pytest.approx(1111.4 / 0.3048, rel=2e-3)
    assert [r["zone_id"] for r in highway.job_bottlenecks(delay).collect()] == [5, 6, 7]
    assert [r["zone_id"] for r in highway.delay_hotspots(delay).collect()] == [5]


def test_network_lines_need_every_vertex(spark):
    net = spark.createDataFrame([(0.0, 0.0, 100.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    lines = spark.createDataFrame(
        [("on", [(0.0, 5.0), (50.0, 9.0)]), ("off", [(0.0, 5.0), (50.0, 90.0)]), ("pair", [(0.0, 1.0), (5.0, 1.0)]), ("pair", [(0.0, 50.0), (5.0, 1.0)])],
        "zone_name string, line array<struct<x:double,y:double>>",
    )
    assert [r["zone_name"] for r in highway.job_network_lines(lines, net, 10.0).collect()] == ["on"]


def test_zone_requests_are_features(spark):
    lines = spark.createDataFrame(
        [("b", [(-94.0, 45.0), (-94.0, 45.01)]), ("a", [(-94.0, 45.0), (-93.99, 45.0)]), ("short", [(-94.0, 45.0), (-94.0, 45.0001)])],
        "zone_name string, line array<struct<x:double,y:double>>",
    )
    zones = highway.job_zone_batches(lines, "Z", size=1)
    assert [(r["row_num"], r["name"], r["direction"], r["batch_name"]) for r in zones.orderBy("row_num").collect()] == [
        (1, "a", 89, "Z_1_of_2"), (2, "b", 360, "Z_2_of_2")
    ]
    body = json.loads(highway.zone_requests(zones).orderBy("batch").first()["body"])
    assert body["zone_set_name"] == "Z_1_of_2"
    assert body["zones"] == [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[-94.0, 45.0], [-93.99, 45.0]]}, "properties": {"id": 1, "name": "a", "is_pass": 1}}]


def test_split_zones_respect_length(spark):
    net = spark.createDataFrame([(0.0, 0.0, 5000.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    lines = spark.createDataFrame(
        [(1, [(0.0, 100.0), (3000.0, 100.0)]), (2, [(0.0, 0.0), (400.0, 0.0)]), (3, [(0.0, 0.0), (0.0, 900.0)])],
        "segment_id int, line array<struct<x:double,y:double>>",
    )
    out = highway.job_split_zones(lines, net, "S", size=2).orderBy("row_num").collect()
    assert [(r["name"], r["part"], r["n_parts"], r["batch_name"]) for r in out] == [
        ("1_1", 1, 3, "S_1_of_2"), ("1_2", 2, 3, "S_1_of_2"), ("1_3", 3, 3, "S_2_of_2")
    ]


XING = (
    "CrossingID string, CrossingIdSuffix string, PosXing int, ReasonID int, TypeXing int, XPurpose int, GateConf int, Gates int, "
    "Channel int, FlashPai int, StopStd int, XBuck int, Whistban int, Latitude double, Longitude double, DayThru int, NghtThru int, MaxTtSpd int"
)


def xing(i, suffix="SOO", pos=1, reason=1, kind=3, purpose=1, conf=0, gates=0, channel=None, flash=0, stop=0, buck=0, ban=None, lat=0.5, night=2):
    return (i, suffix, pos, reason, kind, purpose, conf, gates, channel, flash, stop, buck, ban, lat, 0.5, 1, night, 40)


@pytest.fixture(scope="module")
def crossings(spark):
    rows = [
        xing("quad", conf=3), xing("median", gates=2, channel=1), xing("gates", gates=2), xing("flash", flash=1, ban=1),
        xing("stop", stop=1, ban=0), xing("buck", buck=1, kind=2), xing("none", ban=2, suffix="XX"), xing("nullgate", gates=None, buck=1),
        xing("ped", purpose=2, night=None), xing("closed", reason=16), xing("noreason", reason=None), xing("over", pos=2), xing("nowhere", lat=None),
        xing("outside", lat=9.0),
    ]
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    areas = spark.createDataFrame([("MN", square)], "area string, rings array<array<struct<x:double,y:double>>>")
    return rail.job_crossings(spark.createDataFrame(rows, XING), areas, rail.owner_table(spark), 1.0, src=6501, dst=6501).cache()


def test_crossing_rules(crossings):
    got = {r["CrossingID"]: (r["Type"], r["WarnDev"], r["QZ"], r["RRname"], r["trainTot"]) for r in crossings.collect()}
    quiet = "Horns Sound"
    assert got == {
        "quad": ("PubHwy", "FourQuad", quiet, "CPRS", 3), "median": ("PubHwy", "GatesWithMedian", quiet, "CPRS", 3),
        "gates": ("PubHwy", "Gates", quiet, "CPRS", 3), "flash": ("PubHwy", "FlashingOnly", "QZ", "CPRS", 3),
        "stop": ("PubHwy", "StopSign", quiet, "CPRS", 3), "buck": ("Priv", "Crossbuck", quiet, "CPRS", 3),
        "none": ("PubHwy", "Unknown", None, None, 3), "nullgate": ("PubHwy", "Unknown", quiet, "CPRS", 3),
        "ped": ("PubPed", "Unknown", quiet, "CPRS", None),
    }


def test_tables_sum_every_category(spark, crossings):
    table = {r["Railroad"]: r for r in rail.job_crossing_table(crossings).collect()}
    assert tuple(table["CPRS"])[1:] == (6, 1, 1, 8)
    warn = rail.job_warning_table(crossings).first()
    assert warn["Railroad"] == "CPRS" and warn["Total"] == 7 and warn["Four Quadrant Gates"] == 1
    mile = 5280.0
    lines = spark.createDataFrame(
        [("CPRS", "M", [(0.0, 0.0), (3 * mile, 0.0)]), ("CPRS", "Y", [(0.0, 0.0), (mile, 0.0)]), ("BNSF", "M", [(0.0, 0.0), (2 * mile, 0.0)]), (None, "M", [(0.0, 0.0), (mile, 0.0)])],
        "RROWNER1 string, NET string, line array<struct<x:double,y:double>>",
    )
    tracks = {r["Railroad"]: r for r in rail.job_track_table(lines, rail.job_crossing_table(crossings)).collect()}
    assert (tracks["CPRS"]["Mainline"], tracks["CPRS"]["Total Miles"], tracks["CPRS"]["Total Grade Crossings"]) == (3.0, 4.0, 8)
    assert tracks["BNSF"]["Private"] is None
    assert (tracks[None]["Total Miles"], tracks[None]["Total Grade Crossings"]) == (6.0, 8)


def test_crash_years_and_repeated_ids(spark, crossings):
    crashes = spark.createDataFrame(
        [("gates", "95", "1", "0"), ("gates", "16", "0", "2"), ("gates", "17", "x", "0"), ("nope", "17", "1", "0")],
        "GXID string, YEAR string, TOTKLD string, TOTINJ string",
    )
    doubled = crossings.unionByName(crossings)
    assert rail.study_crashes(crashes, doubled).count() == 3
    row = rail.job_crash_severity(crashes, crossings).collect()
    assert [tuple(r) for r in row] == [("gates", 0, 1, 1, 2)]


def test_rail_volume_fills_from_the_nearest_known_line(spark):
    lines = spark.createDataFrame(
        [(1, "M", [(0.0, 0.0), (10.0, 0.0)]), (2, "M", [(0.0, 50.0), (10.0, 50.0)]), (3, "M", [(0.0, 60.0), (10.0, 60.0)]), (4, "Y", [(0.0, 61.0), (10.0, 61.0)])],
        "OBJECTID int, NET string, line array<struct<x:double,y:double>>",
    )
    xings = spark.createDataFrame(
        [(1, 5, 40, 1.0, 1.0), (2, 5, 50, 2.0, 1.0), (3, 9, 50, 3.0, 1.0), (4, 2, 10, 5.0, 51.0)],
        "CrossingID int, trainTot int, MaxTtSpd int, x double, y double",
    )
    got = {r["OBJECTID"]: (r["trains"], r["speed"]) for r in rail.job_rail_volume(xings, lines).collect()}
    assert got == {1: (5, 50), 2: (2, 10), 3: (2, 10)}


def test_carrier_screen_edges(spark):
    base = dict(PHY_STATE="MN", MAILING_STATE="MN", PHY_ZIP="55101-1234", MCS150_DATE="01-JAN-20", PC_FLAG="N",
                PRIVATE_PASSENGER_BUSINESS="N", PRIVATE_PASSENGER_NONBUSINESS="N", NBR_POWER_UNIT=2, DRIVER_TOTAL=3, MCS150_MILEAGE=10)
    variants = [{}, {"MCS150_MILEAGE": None}, {"MCS150_DATE": "01-JAN-18"}, {"MCS150_DATE": "01-JAN-24"}, {"MCS150_DATE": "01-JAN-19"},
                {"DRIVER_TOTAL": 20}, {"NBR_POWER_UNIT": 30}, {"PC_FLAG": "Y"}, {"PHY_STATE": "TX"}, {"MAILING_STATE": "WI"}, {"MCS150_DATE": None}]
    df = spark.createDataFrame([{**base, **v} for v in variants], ", ".join(
        f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in base.items()))
    screened = carriers.screen_carriers(df)
    assert screened.count() == 4
    zips = spark.createDataFrame([("55101",), ("55102",)], "ZCTA5CE10 string")
    got = sorted((r["ZCTA5CE10"], r["trucks"], r["mileage"]) for r in carriers.job_carriers(screened, zips).collect())
    assert got == [("55101", 8, 30), ("55102", None, None)]
    assert carriers.address_mismatch(df, "MN").count() == 2


def test_density_integrates_to_one_and_keeps_unknown_fuel(spark):
    rows = [(None if i % 3 == 0 else "Ethanol" if i % 3 == 1 else "Diesel", str(10 * math.sin(i))) for i in range(300)] + [("Ethanol", "999"), ("Ethanol", "n/a")]
    df = spark.createDataFrame(rows, "`Fuel Category` string, `Current Certified CI` string")
    out = carriers.job_carbon_density(df, n=601).toPandas()
    assert set(out["chart_name"]) == {"NA (100)", "Ethanol (102)"}
    for _, part in out.groupby("chart_order"):
        assert part["density"].sum() == pytest.approx(1, abs=0.01)


def test_population_change_across_boundaries(spark):
    def square(x, y, s):
        return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]

    schema = "GEOID string, estimate double, rings array<array<struct<x:double,y:double>>>"
    old = spark.createDataFrame([("A", 10.0, square(0.0, 0.0, 1.0)), ("B", 20.0, square(1.0, 0.0, 1.0)), ("C", 5.0, square(9.0, 9.0, 1.0)), ("flat", 1.0, square(0.0, 0.0, 0.0))], schema)
    new = spark.createDataFrame([("A", 45.0, square(0.0, 0.0, 2.0)), ("C", 7.0, square(30.0, 30.0, 1.0))], schema)
    patch = spark.createDataFrame([("C", 4.0, None)], "GEOID_new string, pop_old double, pop_new double")
    got = {r["GEOID"]: (r["pop_old"], r["pop_new"], r["change"], r["percChange"]) for r in population.job_population_change(old, new, 1.0).collect()}
    assert got == {"A": (30.0, 45.0, 15.0, 0.5), "B": (None,) * 4, "C": (None, 7.0, None, None)}
    got = {r["GEOID"]: r["change"] for r in population.job_population_change(old, new, 1.0, patch).collect()}
    assert got["C"] == 3.0
    assert population.population_density(old).count() == 3
