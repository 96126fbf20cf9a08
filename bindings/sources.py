"""Files written to a new folder and read back."""

from pyspark.sql import functions as F

from haulgrid.functions import geometry
from haulgrid.operators import spatial
from haulgrid.session import new_path
from haulgrid.sources import geojson as G
from haulgrid.sources import payloads as P
from haulgrid.sources import tables as S

from .registry import ORACLES, query, table
from .shapes import PTS, TWO_PART_EDGES, points, two_part_areas


@query("scan_csv_typed", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS code, c_acctbal AS amount FROM customer
""")
def scan_csv_typed(spark, d):
    out = new_path(spark, "csv")
    table(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 15, "0").alias("code"), F.col("c_acctbal").alias("amount")
    ).write.option("header", True).option("compression", "gzip").csv(out)
    return S.read_table(spark, out, "code string, amount double")


@query("scan_glob_append", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS a, NULL AS b FROM orders
UNION ALL SELECT CAST(event_id AS VARCHAR), NULL, event_type FROM events
""")
def scan_glob_append(spark, d):
    out = new_path(spark, "glob")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a")).write.option(
        "header", True).csv(f"{out}/AccA")
    table(spark, d, "events").select(F.col("event_type").alias("b"), F.col("event_id").alias("id")).write.option(
        "header", True).csv(f"{out}/AccB")
    return S.read_glob_text(spark, f"{out}/Acc*/part-*")


@query("scan_layers_tagged", """
SELECT 'nation' AS layer, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation
UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
""")
def scan_layers_tagged(spark, d):
    out = new_path(spark, "layers")
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    S.save_tables(
        {
            "nation": n.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")),
            "customer": c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
        },
        out,
    )
    return S.read_layers(spark, f"{out}/*", by="folder").select("layer", "key", "name")


@query("geojson_parse", """
SELECT c_custkey AS id, c_name AS name, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y
FROM customer
""")
def geojson_parse(spark, d):
    out = new_path(spark, "features")
    c = table(spark, d, "customer")
    text = F.format_string(
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[%d,%d,5.5]},"properties":{"id":%d,"name":"%s"}}',
        (F.col("c_custkey") * 37) % 1000, (F.col("c_custkey") * 91) % 1000, "c_custkey", "c_name",
    )
    c.select(text.alias("value")).write.text(out)
    return G.read_geojson(spark, out, "id bigint, name string").select("id", "name", "point.x", "point.y")


@query("geojson_emit", """
SELECT s_suppkey AS id, s_name AS name, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS x0,
       CAST(((s_suppkey + 1) * 91) % 1000 AS DOUBLE) AS y1, 2 AS n
FROM supplier
""")
def geojson_emit(spark, d):
    out = new_path(spark, "emit")
    k = F.col("s_suppkey")

    def vertex(key):
        return F.struct(((key * 37) % 1000).cast("double").alias("x"), ((key * 91) % 1000).cast("double").alias("y"))

    lines = table(spark, d, "supplier").select(
        k.alias("id"), F.col("s_name").alias("name"), F.array(vertex(k), vertex(k + 1)).alias("line")
    )
    G.write_features(lines, out, "line", "LineString", ["id", "name"])
    back = G.read_geojson(spark, out, "id bigint, name string")
    line = F.col("lines")[0]
    return back.select("id", "name", line[0]["x"].alias("x0"), line[1]["y"].alias("y1"), F.size(line).alias("n"))


@query("sink_csv_roundtrip", """
SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def sink_csv_roundtrip(spark, d):
    out = new_path(spark, "sink")
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    S.write_csv(t, out)
    return S.read_table(spark, out, "p string, n bigint, total double")


@query("checkpoint_roundtrip", """
SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def checkpoint_roundtrip(spark, d):
    out = new_path(spark, "tables")
    S.save_tables({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, out)
    t = S.load_tables(spark, out, ["nation", "region"])
    return t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )


@query("batch_payloads", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS row_num FROM orders),
b AS (SELECT *, CAST(ceil(row_num / 1000.0) AS INT) AS batch FROM r)
SELECT batch, 'Zone_' || batch || '_of_' || (SELECT max(batch) FROM b) AS batch_name, count(*) AS n_rows,
  '{"geom_type":"line","zone_set_name":"Zone_' || batch || '_of_' || (SELECT max(batch) FROM b) || '","zones":[' ||
  string_agg('{"row_num":' || row_num || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY row_num)
  || ']}' AS body
FROM b GROUP BY batch
""")
def batch_payloads(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return P.batch_payloads(o, 1000, "Zone", ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("batch_configs", """
WITH b AS (SELECT DISTINCT CAST(ceil(row_num / 1000.0) AS INT) AS batch FROM (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS row_num FROM orders))
SELECT batch_name, '{"analysis_name":"' || batch_name || '_SegmentAnalysis","travel_mode_type":"Truck","oz_sets":[{"name":"'
  || batch_name || '"}]}' AS config
FROM (SELECT 'Zone_' || batch || '_of_' || (SELECT max(batch) FROM b) AS batch_name FROM b)
""")
def batch_configs(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    numbered = P.number_batches(o, 1000, ["o_orderkey"], "Zone")
    return P.request_configs(numbered, {"travel_mode_type": "Truck"}, "_SegmentAnalysis")


@query("layer_two_part_areas", f"""
WITH {PTS}, {TWO_PART_EDGES},
hit AS (SELECT area, id FROM pts JOIN two_part ON (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x
  GROUP BY area, id HAVING count(*) % 2 = 1),
ring AS (SELECT area, r, abs(sum(x1 * y2 - x2 * y1)) / 2 AS size FROM two_part GROUP BY area, r),
sized AS (SELECT area, round(sum(CASE WHEN r = 1 THEN -size ELSE size END), 4) AS sqft FROM ring GROUP BY area)
SELECT area, sqft, count(id) AS points FROM sized LEFT JOIN hit USING (area) GROUP BY area, sqft
""")
def layer_two_part_areas(spark, d):
    """A layer of two-part areas with holes, written, read back and joined with points."""
    out = new_path(spark, "two-part-areas")
    G.write_features(two_part_areas(spark, d), out, "polygons", "MultiPolygon", ["area"])
    layer = G.read_geojson(spark, out, "area int").select("area", "polygons")
    joined = spatial.spatial_join(
        layer.withColumn("sqft", F.round(geometry.whole_area(layer, "polygons"), 4)), points(spark, d), "polygons", "area"
    )
    return joined.groupBy("area", "sqft").agg(F.count("id").alias("points"))


@query("geojson_document", """
SELECT CAST(s_suppkey AS BIGINT) AS id, kind, CAST(s_suppkey % 90 AS DOUBLE) AS x, CAST(CASE WHEN kind = 'Point' THEN 1 ELSE 2 END AS INTEGER) AS n
FROM supplier, (VALUES ('Point'), ('MultiPoint'), ('LineString'), ('MultiLineString'), ('Polygon'), ('MultiPolygon')) k(kind)
""")
def geojson_document(spark, d):
    """A document with every geometry type for each supplier: type, first coordinate and number of its points, parts or rings."""
    return _first_coordinates(G.read_geojson(spark, _supplier_documents(spark, d), "id long"))


@query("geojson_document_split", ORACLES["geojson_document"])
def geojson_document_split(spark, d):
    """The same documents, split at braces instead of lines."""
    return _first_coordinates(G.read_geojson_document(spark, _supplier_documents(spark, d), "id long"))


def _supplier_documents(spark, d):
    shapes = {
        "Point": "[%1$d,1]", "MultiPoint": "[[%1$d,1],[2,3]]", "LineString": "[[%1$d,1],[2,3]]",
        "MultiLineString": "[[[%1$d,1],[2,3]],[[4,5],[6,7]]]", "Polygon": "[[[%1$d,0],[90,0],[90,90],[%1$d,0]],[[80,10],[85,10],[85,20],[80,10]]]",
        "MultiPolygon": "[[[[%1$d,0],[90,0],[90,90],[%1$d,0]]],[[[100,0],[101,0],[101,1],[100,0]]]]",
    }
    key = F.col("s_suppkey").cast("long")
    parts = [
        F.format_string(
            f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":{text}}},"properties":{{"id":%2$d}}}}', key % 90, key
        )
        for kind, text in shapes.items()
    ]
    out = new_path(spark, "document")
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *parts), F.lit("]}"))
    table(spark, d, "supplier").select(whole).write.text(out)
    return out


def _first_coordinates(read):
    kind = F.col("geometry_type")
    first = F.when(kind == "Point", F.col("point")).when(kind == "MultiPoint", F.col("points")[0]).when(
        kind.contains("Line"), F.col("lines")[0][0]
    ).otherwise(F.col("polygons")[0][0][0])
    n = F.when(kind == "Point", 1).when(kind == "MultiPoint", F.size("points")).when(
        kind == "LineString", F.size(F.col("lines")[0])
    ).when(kind == "MultiLineString", F.size("lines")).when(kind == "Polygon", F.size(F.col("polygons")[0])).otherwise(F.size("polygons"))
    return read.select("id", kind.alias("kind"), first["x"].alias("x"), n.cast("int").alias("n"))
