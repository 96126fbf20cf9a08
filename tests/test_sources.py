"""Readers and writers on small files."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from haulgrid import session
from haulgrid.session import configure, materialize, new_path, release
from haulgrid.sources import geojson as G
from haulgrid.sources import payloads as P
from haulgrid.sources import tables as S


def test_codes_keep_leading_zeros_also_from_gzip(spark, tmp_path):
    path = tmp_path / "jobs.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("w_geocode,C000\n010010201001000,5\n270010201001001,\n")
    df = S.read_table(spark, str(path), "w_geocode string, C000 int", partitions=3)
    assert sorted(map(tuple, df.collect())) == [("010010201001000", 5), ("270010201001001", None)]
    assert df.rdd.getNumPartitions() == 3


def test_files_with_other_columns_are_appended_as_text(spark, tmp_path):
    (tmp_path / "Acc1.csv").write_text("GXID,YEAR\n007,16\n")
    (tmp_path / "Acc2.csv").write_text("YEAR,TOTKLD,GXID\n95,1,008\n")
    (tmp_path / "other.csv").write_text("GXID\n1\n")
    df = S.read_glob_text(spark, f"{tmp_path}/Acc*.csv")
    got = sorted((r["GXID"], r["YEAR"], r["TOTKLD"]) for r in df.collect())
    assert got == [("007", "16", None), ("008", "95", "1")]
    with pytest.raises(FileNotFoundError):
        S.read_glob_text(spark, f"{tmp_path}/none*.csv")


def test_layer_is_the_file_name(spark, tmp_path):
    (tmp_path / "roads.csv").write_text("id\n1\n")
    (tmp_path / "rail.csv").write_text("id\n2\n")
    df = S.read_layers(spark, f"{tmp_path}/*.csv", "id int", "csv")
    assert sorted(map(tuple, df.collect())) == [(1, "roads"), (2, "rail")]


FEATURES = [
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 9]}, "properties": {"id": 1}},
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4.5]]}, "properties": {"id": 2}},
    {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6]]]}, "properties": {"id": 3}},
    {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"id": 4}},
    {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}, "properties": {"id": None}},
]


@pytest.mark.parametrize("form", ["lines", "document"])
def test_mixed_geometry_types(spark, tmp_path, form):
    path = tmp_path / "layer.geojson"
    if form == "lines":
        path.write_text("\n".join(json.dumps(f) for f in FEATURES) + "\n")
        df = G.read_geojson(spark, str(path), "id int")
    else:
        path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
        df = G.read_geojson_document(spark, str(path), "id int")
    got = {r["geometry_type"]: r.asDict(recursive=True) for r in df.collect()}
    assert len(got) == 5
    assert got["Point"]["point"] == {"x": 1.0, "y": 2.0}
    assert got["LineString"]["lines"] == [[{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.5}]]
    assert len(got["MultiLineString"]["lines"]) == 2
    assert len(got["Polygon"]["polygons"][0][0]) == 4
    assert got["MultiPolygon"]["id"] is None and len(got["MultiPolygon"]["polygons"]) == 1


def test_features_are_valid_json_one_per_line(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [(0.0, 1.0), (2.0, 3.0)])], "id int, name string, line array<struct<x:double,y:double>>")
    G.write_features(df, str(tmp_path / "out"), "line", "LineString", ["id", "name"])
    text = spark.read.text(str(tmp_path / "out")).first()[0]
    assert json.loads(text) == {
        "type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]},
        "properties": {"id": 1, "name": None},
    }


def test_payloads_hold_every_row_once_in_order(spark):
    df = spark.range(25).select("id", F.when(F.col("id") != 3, F.col("id") * 2).alias("v"))
    out = P.batch_payloads(df, 10, "Zone", [-F.col("id")], ["id", "v"], {"geom_type": "line"}).orderBy("batch").collect()
    assert [(r["batch_name"], r["n_rows"]) for r in out] == [("Zone_1_of_3", 10), ("Zone_2_of_3", 10), ("Zone_3_of_3", 5)]
    bodies = [json.loads(r["body"]) for r in out]
    assert [z["id"] for b in bodies for z in b["zones"]] == list(range(24, -1, -1))
    assert bodies[2]["zones"][1] == {"row_num": 22, "id": 3, "v": None}


def test_one_config_per_batch(spark):
    batches = spark.createDataFrame([("Z_1_of_1",), ("Z_1_of_1",)], "batch_name string")
    rows = P.request_configs(
        batches, {"day_types": "AllDays|17", "date_ranges": F.array(F.struct(F.lit("01/01/2021").alias("start_date")))}, "_ZA"
    ).collect()
    assert len(rows) == 1
    assert json.loads(rows[0]["config"]) == {
        "analysis_name": "Z_1_of_1_ZA", "day_types": "AllDays|17", "date_ranges": [{"start_date": "01/01/2021"}],
        "oz_sets": [{"name": "Z_1_of_1"}],
    }


def test_materialized_table_has_no_lineage(spark):
    df = spark.range(5).withColumn("x", F.col("id") + 1)
    out = materialize(df)
    assert sorted(map(tuple, out.collect())) == [(i, i + 1) for i in range(5)]
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert new_path(spark, "a") != new_path(spark, "a")


def test_release_deletes_what_was_written(spark):
    out = materialize(spark.range(3))
    path = out.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert Path(path).exists()
    assert release(spark) >= 1 and not Path(path).exists()
    assert release(spark) == 0


def test_configure_is_repeatable(spark):
    assert configure(configure(spark)) is spark


def test_no_shared_folder_raises(spark, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        materialize(spark.range(3))
    with pytest.raises(RuntimeError):
        materialize(spark.range(3), row_key="k")


def test_released_leaves_earlier_tables(spark):
    kept = materialize(spark.range(3))
    with session.released(spark):
        inner = materialize(spark.range(2)).inputFiles()[0]
    assert not Path(inner.removeprefix("file:")).exists() and kept.count() == 3


def test_collections_on_one_line_and_features_without_geometry(spark, tmp_path):
    lone = {"type": "Feature", "geometry": None, "properties": {"id": 9}}
    many = {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4, 5]]}, "properties": {"id": 8}}
    one = tmp_path / "one.geojson"
    one.write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": [*FEATURES, lone, many]}))
    rows = G.read_geojson(spark, str(one), "id int").collect()
    assert len(rows) == 7
    got = {r["id"]: r for r in rows}
    assert got[9]["geometry_type"] is None and got[9]["point"] is None
    assert [tuple(p) for p in got[8]["points"]] == [(1.0, 2.0), (3.0, 4.0)]
    wrapped = tmp_path / "wrapped.geojson"
    body = ",\n".join(json.dumps(f) for f in [*FEATURES, lone])
    wrapped.write_text('{\n"type": "FeatureCollection",\n"name": "x",\n"features": [\n' + body + "\n]\n}\n")
    assert G.read_geojson(spark, str(wrapped), "id int").count() == 6


def test_broken_lines_are_reported(spark, tmp_path):
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps(FEATURES[0]) + '\n{"type": "Feature", "geom\nnonsense\n')
    with pytest.raises(Exception, match="not a GeoJSON feature"):
        G.read_geojson(spark, str(path), "id int").collect()
    rows = G.read_geojson(spark, str(path), "id int", broken="keep").collect()
    assert sorted(r["broken"] or "" for r in rows) == ["", "nonsense", '{"type": "Feature", "geom']


def test_inferred_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert dict(S.read_table(spark, str(tmp_path / "t.csv"), infer=True).dtypes) == {"a": "int", "b": "string"}
    assert dict(S.read_table(spark, str(tmp_path / "t.csv")).dtypes) == {"a": "string", "b": "string"}


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


NAMES = ["plain", 'a "quoted" }{ brace', "back\\slash\\", "}}}}", '{"type": "Feature"}', "\\\"", "", "long " * 300, "äöü }\n{"]


@pytest.mark.parametrize("indent", [None, 2])
def test_document_is_read_in_many_tasks(spark, tmp_path, small_splits, indent):
    features = [
        {"type": "Feature", "properties": {"id": i, "name": NAMES[i % len(NAMES)], "more": {"deep": {"er": "}"}}},
         "geometry": {"type": "Point", "coordinates": [i, -i]} if i % 4 else None}
        for i in range(60)
    ]
    crs = {"type": "name", "properties": {"name": "urn:{odd}"}}
    path = tmp_path / "layers"
    path.mkdir()
    document = {"type": "FeatureCollection", "name": "one { brace", "crs": crs, "features": features[:40], "bbox": [0, 0, 1, 1]}
    (path / "a.geojson").write_text(json.dumps(document, indent=indent, ensure_ascii=False))
    two = [{"features": features[40:50], "type": "FeatureCollection", "crs": crs}, {"type": "FeatureCollection", "features": features[50:]}]
    (path / "b.geojson").write_text("\n".join(json.dumps(t, indent=indent) for t in two) + "\n")
    (path / "none.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (path / "empty.geojson").write_text("")
    df = G.read_geojson_document(spark, str(path), "id int, name string")
    got = {r["id"]: (r["name"], r["point"] and (r["point"]["x"], r["point"]["y"])) for r in df.collect()}
    assert df.count() == 60
    assert got == {i: (NAMES[i % len(NAMES)], (i, -i) if i % 4 else None) for i in range(60)}
    assert G._chunks(spark, str(path)).select("file", "block").distinct().count() > 8


@pytest.mark.parametrize("cut", [95, 130, 165])
def test_document_that_ends_inside_a_feature_fails(spark, tmp_path, cut):
    text = json.dumps({"type": "FeatureCollection", "features": FEATURES})
    path = tmp_path / "cut.geojson"
    path.write_text(text[:cut])
    with pytest.raises(Exception, match="not a whole GeoJSON feature"):
        G.read_geojson_document(spark, str(path), "id int").collect()
