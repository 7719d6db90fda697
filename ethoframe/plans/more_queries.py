"""Queries on expressions and operators that need no frame table of their own module: text, maps, geometry, kinematics, runs, patterns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ethoframe.functions import angles, arrays, columns, geometry, text
from ethoframe.operators import align, bouts, patterns, runs, selection, smoothing
from ethoframe.plans.inputs import BOUTS, E, FPS, IDS, RUNS, event_bouts, events, r6, sql, table
from ethoframe.plans.registry import query

RUN_ROWS = "SELECT user_id, start_index, end_index, run_length, run_value FROM runs"
CHUNK_ROWS = "SELECT user_id, start_index AS index_start, end_index AS index_end, run_value AS value, run_length AS length FROM runs"


# text and maps


@query("SELECT c_custkey, regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1) AS number FROM customer WHERE regexp_matches(c_name, '#0*([1-9][0-9]*)$') UNION ALL SELECT c_custkey, NULL FROM customer WHERE NOT regexp_matches(c_name, '#0*([1-9][0-9]*)$')")
def extract_regex_from_string(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.first_match(F.col("c_name"), "#0*([1-9][0-9]*)$").alias("number"))


@query("SELECT p_partkey, regexp_extract(p_name, '^([a-z]+) ', 1) AS adjective, trim(replace(p_name, regexp_extract(p_name, '^([a-z]+) ', 0), ''), '_ -') AS remaining FROM part WHERE regexp_matches(p_name, '^([a-z]+) ')")
def extract_regex_from_unstructured_string(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where(F.regexp_like("p_name", F.lit("^([a-z]+) ")))
    return rows.select("p_partkey", *(c.alias(n) for n, c in text.extract_fields(F.col("p_name"), {"adjective": "^([a-z]+) "}).items()))


@query("SELECT c_custkey, round(c_acctbal / 2.54, 6) + 0.0 AS inch FROM customer")
def cm2inch(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r6(text.cm_to_inch(F.col("c_acctbal"))).alias("inch"))


@query("SELECT c_custkey, round(c_acctbal * 2.54, 6) + 0.0 AS cm FROM customer")
def inch2cm(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r6(text.inch_to_cm(F.col("c_acctbal"))).alias("cm"))


@query("SELECT event_id, CAST(event_id * 97 // 86400 AS VARCHAR) || ' days ' || lpad(CAST(event_id * 97 % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id * 97 % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id * 97 % 60 AS VARCHAR), 2, '0') AS duration FROM events")
def strfdelta(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.duration_text(F.col("event_id") * 97).alias("duration"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def get_dict_value_by_graph(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_at(F.col("props"), ["k"]).alias("k"))


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def nested_dict_leaf_iterator(spark, sf_dir):
    return text.json_leaves(table(spark, sf_dir, "events"), ["event_id"], "props")


@query("SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS event_type, CAST(user_id AS DOUBLE) AS user_id FROM events")
def numerize_string_values_in_dict(spark, sf_dir):
    m = text.numeric_values(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", m["a"].alias("event_type"), m["b"].alias("user_id"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN user_id END, -1) AS a, CAST(5 AS BIGINT) AS b FROM events")
def update_default_dict(spark, sf_dir):
    given = F.create_map(F.lit("a"), F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("user_id")), F.lit("c"), F.col("user_id"))
    defaults = F.create_map(F.lit("a"), F.lit(-1).cast("long"), F.lit("b"), F.lit(5).cast("long"))
    m = text.with_defaults(given, defaults)
    return table(spark, sf_dir, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 1 THEN 'a' END, CASE WHEN o_custkey % 3 = 1 THEN 'b' END], lambda x: x IS NOT NULL), ',') AS keys FROM orders")
def get_key_by_value(spark, sf_dir):
    m = F.create_map(F.lit("a"), F.pmod("o_orderkey", F.lit(3)), F.lit("b"), F.pmod("o_custkey", F.lit(3)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.keys_of(m, F.lit(1).cast("long")), ",").alias("keys"))


@query("SELECT event_id, chr(CAST(97 + user_id % 26 AS INT)) || chr(CAST(97 + event_id % 26 AS INT)) AS synonym FROM events")
def int_sequence_to_string_synonym(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", text.int_synonym(F.array(F.pmod("user_id", F.lit(26)), F.pmod("event_id", F.lit(26)))).alias("synonym"))


@query("SELECT event_id, list_reduce(list_transform(string_split(event_type, ''), lambda c: CAST(ord(c) - 97 AS BIGINT)), lambda a, b: a * 31 + b) AS folded FROM events")
def string_synonym_to_int_sequence(spark, sf_dir):
    numbers = text.synonym_ints(F.col("event_type"))
    folded = F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a * 31 + b)
    return table(spark, sf_dir, "events").select("event_id", folded.alias("folded"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'one' WHEN 'Brand#2' THEN 'two' ELSE 'other' END AS brand FROM part")
def replace_axis_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.translate_values(F.col("p_brand"), {"Brand#1": "one", "Brand#2": "two"}, F.lit("other")).alias("brand"))


# arrays


@query("SELECT o_orderkey, CAST(ceil((o_custkey % 9 + 1) / 2) - 1 AS BIGINT) AS middle FROM orders")
def get_middle_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", arrays.middle_index(F.pmod("o_custkey", F.lit(9)) + 1).cast("long").alias("middle"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || ':' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 1 AS VARCHAR) ELSE '-1' END || ',' || CASE WHEN p_size % 2 = 0 THEN '-1:' || CAST(p_size + 2 AS VARCHAR) ELSE '-1:-1' END AS zipped FROM part")
def zip_unequal(spark, sf_dir):
    a, even = F.array(F.col("p_size")), F.pmod("p_size", F.lit(2)) == 0
    b = F.when(even, F.array(F.col("p_size") + 1, F.col("p_size") + 2)).otherwise(F.array().cast("array<int>"))
    pairs = arrays.zip_to(a, b, F.lit(2), F.lit(-1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["a"].cast("string"), p["b"].cast("string"))), ",").alias("zipped"))


# angles, transforms, boxes and polygons


@query(sql(E, "SELECT event_id, round((x * 3 - y * 7 + 180) - floor((x * 3 - y * 7 + 180) / 360) * 360 - 180, 6) + 0.0 AS delta FROM e"))
def delta_angle(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(angles.delta_angle(F.col("x") * 3, F.col("y") * 7)).alias("delta"))


@query(sql(E, "SELECT event_id, round(sqrt(x * x + y * y), 6) AS rho, round(atan2(y, x), 6) + 0.0 AS phi FROM e"))
def np_scalar_to_polar(spark, sf_dir):
    p = angles.polar(F.col("x"), F.col("y"))
    return events(spark, sf_dir).select("event_id", r6(p["rho"]).alias("rho"), r6(p["phi"]).alias("phi"))


@query(sql(E, "SELECT event_id, round(x * cos(y), 6) + 0.0 AS px, round(x * sin(y), 6) + 0.0 AS py FROM e"))
def np_polar_to_scalar(spark, sf_dir):
    p = angles.cartesian(F.col("x"), F.col("y"))
    return events(spark, sf_dir).select("event_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


@query(sql(E, f"SELECT event_id, round((x - 10) * cos({math.pi / 3}) - (y - 5) * sin({math.pi / 3}) + 10, 6) + 0.0 AS px, round((x - 10) * sin({math.pi / 3}) + (y - 5) * cos({math.pi / 3}) + 5, 6) + 0.0 AS py FROM e"))
def rotate_points_np_old(spark, sf_dir):
    p = angles.rotate(F.col("x"), F.col("y"), F.lit(math.pi / 3), F.lit(10.0), F.lit(5.0))
    return events(spark, sf_dir).select("event_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


MATRIX = [[2.0, 1.0, 3.0], [-1.0, 4.0, 0.5]]


@query(sql(E, "SELECT event_id, round(x * 2 + y * 1 + 3, 6) AS px, round(x * -1 + y * 4 + 0.5, 6) + 0.0 AS py FROM e"))
def apply_transform_matrix(spark, sf_dir):
    p = angles.affine(F.col("x"), F.col("y"), MATRIX)
    return events(spark, sf_dir).select("event_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


@query(sql(E, "SELECT event_id, round(x * 2 + y * -1 + 3, 6) + 0.0 AS px, round(x * 1 + y * 4 + 0.5, 6) + 0.0 AS py FROM e"))
def multiply_by_matrix(spark, sf_dir):
    p = angles.row_transform(F.col("x"), F.col("y"), [[2.0, 1.0], [-1.0, 4.0], [3.0, 0.5]])
    return events(spark, sf_dir).select("event_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


@query(sql(E, "SELECT event_id, round(x, 6) + 0.0 AS px, round(y, 6) + 0.0 AS py FROM e"))
def apply_inverse_transform(spark, sf_dir):
    there = events(spark, sf_dir).withColumn("_p", angles.affine(F.col("x"), F.col("y"), MATRIX))
    p = angles.affine(F.col("_p.x"), F.col("_p.y"), angles.inverted_affine(MATRIX))
    return there.select("event_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


@query("SELECT o_orderkey, round((o_totalprice - 12.5) / 3.5, 6) AS x FROM orders")
def inverse_linear_transform(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(angles.inverse_linear(F.lit(3.5), F.lit(12.5), F.col("o_totalprice"))).alias("x"))


@query("SELECT o_orderkey, round(-o_totalprice / ((o_custkey + 1) * CAST(3.7 AS DOUBLE)), 6) + 0.0 AS zero FROM orders")
def find_linear_zero(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(angles.linear_zero((F.col("o_custkey") + 1) * 3.7, F.col("o_totalprice"))).alias("zero"))


def _line_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return rows.withColumn("box", geometry.box(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_linenumber") * 2.0, F.lit(4.0)))


def _box_columns(b):
    return [r6(b[c]).alias(c) for c in "xywh"]


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_BOX = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_discount * 100 AS y, CAST(l_linenumber * 2 AS DOUBLE) AS w, CAST(4 AS DOUBLE) AS h FROM lineitem)"
BOX_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM b"))
def create_box(spark, sf_dir):
    return _line_boxes(spark, sf_dir).select(*KEY, *_box_columns(F.col("box")))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, round(x + w / 2 - w * 1.5 / 2 - 1, 6) + 0.0 AS x, round(y + h / 2 - h * 0.5 / 2 - 2, 6) + 0.0 AS y, round(w * 1.5 + 2, 6) + 0.0 AS w, round(h * 0.5 + 4, 6) + 0.0 AS h FROM b"))
def scale_and_pad_bbox(spark, sf_dir):
    return _line_boxes(spark, sf_dir).select(*KEY, *_box_columns(geometry.scale_box(F.col("box"), 1.5, 0.5, 1, 2)))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, CASE WHEN x < 30 AND 10 < x + w AND y < 8 AND 2 < y + h THEN round(greatest(x, 10.0), 6) END AS x, CASE WHEN x < 30 AND 10 < x + w AND y < 8 AND 2 < y + h THEN round(least(x + w, 30.0) - greatest(x, 10.0), 6) END AS w, CASE WHEN x < 30 AND 10 < x + w AND y < 8 AND 2 < y + h THEN round(greatest(y, 2.0), 6) END AS y, CASE WHEN x < 30 AND 10 < x + w AND y < 8 AND 2 < y + h THEN round(least(y + h, 8.0) - greatest(y, 2.0), 6) END AS h FROM b"))
def get_bbox_intersection(spark, sf_dir):
    area = geometry.box(F.lit(10.0), F.lit(2.0), F.lit(20.0), F.lit(6.0))
    cut = geometry.box_intersection(F.col("box"), area)
    return _line_boxes(spark, sf_dir).select(*KEY, *_box_columns(cut))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, x BETWEEN 10 AND 30 AND round(y, 6) BETWEEN 2 AND 8 AS inside FROM b"))
def check_point_in_bbox(spark, sf_dir):
    area = geometry.box(F.lit(10.0), F.lit(2.0), F.lit(20.0), F.lit(6.0))
    return _line_boxes(spark, sf_dir).select(*KEY, geometry.in_box(F.col("box.x"), F.round("box.y", 6), area).alias("inside"))


@query(sql(LINE_BOX, "SELECT l_orderkey, round(min(x), 6) + 0.0 AS x, round(min(y), 6) + 0.0 AS y, round(max(x + w) - min(x), 6) + 0.0 AS w, round(max(y + h) - min(y), 6) + 0.0 AS h FROM b GROUP BY l_orderkey"))
def cumulative_bbox(spark, sf_dir):
    merged = _line_boxes(spark, sf_dir).groupBy("l_orderkey").agg(geometry.union_box(F.col("box")).alias("box"))
    return merged.select("l_orderkey", *_box_columns(F.col("box")))


@query(sql(E, "SELECT user_id, round(min(x), 6) + 0.0 AS x, round(min(y), 6) + 0.0 AS y, round(max(x) - min(x), 6) + 0.0 AS w, round(max(y) - min(y), 6) + 0.0 AS h FROM e GROUP BY user_id"))
def get_2d_point_groups_bboxes(spark, sf_dir):
    boxes = events(spark, sf_dir).groupBy("user_id").agg(geometry.points_box(F.col("x"), F.col("y")).alias("box"))
    return boxes.select("user_id", *_box_columns(F.col("box")))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, round(x, 6) + 0.0 AS x1, round(y, 6) + 0.0 AS y1, round(x + w, 6) + 0.0 AS x2, round(y + h, 6) + 0.0 AS y2 FROM b"))
def matplotlib_bbox_to_shapely_bbox(spark, sf_dir):
    corners = geometry.box_to_corners(F.col("box"))
    return _line_boxes(spark, sf_dir).select(*KEY, *(r6(corners[c]).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(w, 6) + 0.0 AS w, round(h, 6) + 0.0 AS h FROM b"))
def shapely_bbox_to_matplotlib_bbox(spark, sf_dir):
    back = geometry.corners_to_box(geometry.box_to_corners(F.col("box")))
    return _line_boxes(spark, sf_dir).select(*KEY, *_box_columns(back))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, i AS corner, round(CASE WHEN i IN (1, 2) THEN x + w ELSE x END, 6) + 0.0 AS px, round(CASE WHEN i >= 2 THEN y + h ELSE y END, 6) + 0.0 AS py, round(w * h, 4) + 0.0 AS area FROM b, (SELECT CAST(unnest(range(4)) AS INTEGER) AS i)"))
def bbox_to_polygon(spark, sf_dir):
    rows = _line_boxes(spark, sf_dir).withColumn("polygon", geometry.box_polygon(F.col("box")))
    rows = rows.withColumn("area", F.abs(geometry.polygon_area(F.col("polygon")))).select(*KEY, "area", F.posexplode("polygon").alias("corner", "p"))
    return rows.select(*KEY, "corner", r6("p.x").alias("px"), r6("p.y").alias("py"), (F.round("area", 4) + F.lit(0.0)).alias("area"))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, i AS corner, round(x + a * w * cos(l_linenumber / 2.0) - c * h * sin(l_linenumber / 2.0), 6) + 0.0 AS px, round(y + a * w * sin(l_linenumber / 2.0) + c * h * cos(l_linenumber / 2.0), 6) + 0.0 AS py FROM b, (VALUES (0, 1, 1), (1, -1, 1), (2, -1, -1), (3, 1, -1)) s(i, a, c)"))
def get_box_points(spark, sf_dir):
    corners = geometry.rotated_corners(F.col("box.x"), F.col("box.y"), F.col("l_linenumber") / 2, F.col("box.w"), F.col("box.h"))
    rows = _line_boxes(spark, sf_dir).select(*KEY, F.posexplode(corners).alias("corner", "p"))
    return rows.select(*KEY, "corner", r6("p.x").alias("px"), r6("p.y").alias("py"))


@query()
def get_rois_from_bbox_list(spark, sf_dir):
    """Boxes of each order's lines, overlapping ones merged; tests hold the operator against merging pairs one by one."""
    return geometry.merge_boxes(_line_boxes(spark, sf_dir).select("l_orderkey", "box"), ["l_orderkey"]).select("l_orderkey", *_box_columns(F.col("box")))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, round(x + w / 2, 4) + 0.0 AS cx, round(y + h / 2, 4) + 0.0 AS cy FROM b"))
def get_polygon_centroid(spark, sf_dir):
    middle = geometry.polygon_centroid(geometry.box_polygon(F.col("box")))
    return _line_boxes(spark, sf_dir).select(*KEY, (F.round(middle["x"], 4) + F.lit(0.0)).alias("cx"), (F.round(middle["y"], 4) + F.lit(0.0)).alias("cy"))


@query(sql(LINE_BOX, f"SELECT {BOX_KEY}, round(2 * x + y + 3, 6) + 0.0 AS x, round(-x + 4 * y + 0.5, 6) + 0.0 AS y, round(2 * w + h, 6) + 0.0 AS w, round(-w + 4 * h, 6) + 0.0 AS h FROM b"))
def apply_transform_to_bbox(spark, sf_dir):
    return _line_boxes(spark, sf_dir).select(*KEY, *_box_columns(geometry.transform_box(F.col("box"), MATRIX)))


@query(sql(E, f"SELECT event_id, i AS point, round(x + y * cos(i * {2 * math.pi / 8}), 6) + 0.0 AS px, round(y * sin(i * {2 * math.pi / 8}), 6) + 0.0 AS py FROM e, (SELECT CAST(unnest(range(8)) AS INTEGER) AS i)"))
def get_circle(spark, sf_dir):
    points = geometry.circle_polygon(F.col("x"), F.lit(0.0), F.col("y"), 8)
    rows = events(spark, sf_dir).select("event_id", F.posexplode(points).alias("point", "p"))
    return rows.select("event_id", "point", r6("p.x").alias("px"), r6("p.y").alias("py"))


@query("SELECT o_orderkey, round((o_totalprice + 2 * o_custkey) / (0.001 * o_custkey + 1), 6) + 0.0 AS px, round((o_custkey + 5) / (0.001 * o_custkey + 1), 6) + 0.0 AS py FROM orders")
def perspective_transform_polygon(spark, sf_dir):
    p = geometry.perspective(F.col("o_totalprice"), F.col("o_custkey").cast("double"), [[1, 2, 0], [0, 1, 5], [0, 0.001, 1]])
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


# columns


@query("SELECT event_id, round(event_id / 30.0 * 1000, 6) AS msec FROM events")
def frame_to_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(columns.msec_of(F.col("event_id"), FPS)).alias("msec"))


@query("SELECT event_id, round(event_id / 30.0, 6) AS seconds FROM events")
def pd_frames_to_timedelta(spark, sf_dir):
    interval = columns.interval_of(F.col("event_id"), FPS)
    seconds = sum((F.extract(F.lit(part), interval).cast("double") * factor for part, factor in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))), F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", r6(seconds).alias("seconds"))


@query(sql(E, "SELECT event_id, coalesce(sparse, y) AS value FROM e"))
def np_update(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", columns.update_missing(F.col("sparse"), F.col("y")).alias("value"))


@query(sql(E, "SELECT event_id, CASE WHEN y > 40 THEN x END AS value FROM e"))
def truncate_array_with_mask(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", columns.masked(F.col("x"), F.col("y") > 40).alias("value"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority, 'orders ' || o_orderstatus || '/' || o_orderpriority AS name FROM orders")
def pd_group_to_string_dict(spark, sf_dir):
    return columns.group_names(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "orders %s/%s")


@query("SELECT 'test' AS experiment, n_nationkey, n_name FROM nation")
def pd_prepend_index_levels(spark, sf_dir):
    return columns.constant_keys(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), {"experiment": "test"})


@query("SELECT n_nationkey, n_regionkey * 10 AS level, n_name FROM nation")
def insert_level_into_index(spark, sf_dir):
    return columns.insert_column(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name"), 1, "level", F.col("n_regionkey") * 10).drop("n_regionkey")


SPLIT = "SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS off, CASE WHEN event_type = 'click' THEN value END AS on_ FROM events"


def _split(spark, sf_dir):
    off, on = columns.split_by(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), F.col("event_type") == "click", ["value"])
    return off.select("event_id", F.col("value").alias("off")).join(on.select("event_id", F.col("value").alias("on_")), "event_id")


@query(SPLIT)
def filter_split_pd(spark, sf_dir):
    return _split(spark, sf_dir)


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'widget$')")
def pd_filter_index(spark, sf_dir):
    return selection.filter_regex(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "widget$")


# runs and patterns


@query(sql(RUNS, RUN_ROWS))
def rle_multi_index_series(spark, sf_dir):
    return runs.run_length_encode(events(spark, sf_dir), "event_type", IDS)


ISLANDS = E + """, g AS (SELECT user_id, frame_index, CAST(value > 100 AS INT) AS on_,
  frame_index - row_number() OVER (PARTITION BY user_id, value > 100 ORDER BY frame_index) AS part FROM e WHERE value IS NOT NULL)"""


def _flat(value):
    """Runs of one series without ids: all events in the order of event_id."""
    return f"""v AS (SELECT event_id, {value} AS v FROM events), g AS (SELECT event_id, v, sum(CASE WHEN n > 1 AND v IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(v) OVER w AS before, row_number() OVER w AS n FROM v WINDOW w AS (ORDER BY event_id))),
runs AS (SELECT min(event_id) AS start_index, max(event_id) AS end_index, CAST(max(event_id) - min(event_id) + 1 AS BIGINT) AS run_length, any_value(v) AS run_value FROM g GROUP BY run)"""


@query(sql(_flat("CAST(value > 100 AS INT)"), "SELECT start_index, end_index, run_length, run_value FROM runs"))
def rle_numeric_single_index_series(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("on_", (F.col("value") > 100).cast("int"))
    return runs.run_length_encode(rows, "on_", (), "event_id")


@query(sql(_flat("event_type"), "SELECT start_index, end_index, run_length, run_value FROM runs"))
def rle_arbitrary_single_index_series(spark, sf_dir):
    return runs.run_length_encode(table(spark, sf_dir, "events"), "event_type", (), "event_id")


@query(sql(RUNS, CHUNK_ROWS))
def multi_index_series_to_value_chunks(spark, sf_dir):
    return runs.value_chunks(events(spark, sf_dir), "event_type", IDS).drop("grouped_index")


@query(sql(_flat("event_type"), "SELECT start_index AS index_start, end_index AS index_end, run_value AS value, run_length AS length FROM runs"))
def flat_index_series_to_value_chunks(spark, sf_dir):
    return runs.value_chunks(table(spark, sf_dir, "events"), "event_type", (), "event_id").drop("grouped_index")


@query(sql(E, "SELECT user_id, frame_index AS \"index\", event_type AS value FROM e"))
def value_chunks_to_multi_index_series(spark, sf_dir):
    return runs.chunks_to_series(runs.value_chunks(events(spark, sf_dir), "event_type", IDS))


@query(sql(_flat("event_type"), "SELECT unnest(range(start_index, end_index + 1)) AS \"index\", run_value AS value FROM runs"))
def value_chunks_to_flat_index_series(spark, sf_dir):
    return runs.chunks_to_series(runs.value_chunks(table(spark, sf_dir, "events"), "event_type", (), "event_id"))


@query(sql(RUNS, "SELECT user_id, start_index AS frame_index, run_value AS event_type FROM runs"))
def filter_consecutive_duplicates(spark, sf_dir):
    return patterns.run_onsets(events(spark, sf_dir), "event_type", IDS).select("user_id", "frame_index", "event_type")


NEXT = "nx AS (SELECT user_id, run_value AS g0, lead(run_value) OVER (PARTITION BY user_id ORDER BY start_index) AS g1 FROM runs)"


@query(sql(RUNS + ", " + NEXT, "SELECT g0, g1, count(*) AS n FROM nx WHERE g0 IS NOT NULL AND g1 IS NOT NULL GROUP BY ALL"))
def get_syllable_transitions(spark, sf_dir):
    return patterns.ngram_counts(events(spark, sf_dir), "event_type", IDS)


@query(sql(RUNS + ", " + NEXT, "SELECT user_id, g0, g1, count(*) AS n FROM nx WHERE g0 IS NOT NULL AND g1 IS NOT NULL GROUP BY ALL"))
def get_group_syllable_transition_series(spark, sf_dir):
    return patterns.ngram_counts(events(spark, sf_dir), "event_type", IDS, per_id=True)


@query(sql(RUNS + ", " + NEXT + ", c AS (SELECT g0, g1, count(*) AS n FROM nx WHERE g0 IS NOT NULL AND g1 IS NOT NULL GROUP BY ALL)", "SELECT g0, g1, round(n / sum(n) OVER (PARTITION BY g0), 6) AS share FROM c"))
def normalize_syllable_transition_series(spark, sf_dir):
    counts = patterns.ngram_counts(events(spark, sf_dir), "event_type", IDS)
    return patterns.normalise_ngrams(counts, "rows").select("g0", "g1", r6("share").alias("share"))


@query(sql(BOUTS, """SELECT p.behavior_name AS previous_behavior, n.behavior_name AS next_behavior, count(*) AS transition_count
        FROM b p JOIN b n ON p.user_id = n.user_id AND n.frame_index = p.end_frame + 1 GROUP BY ALL"""))
def single_bout_df_to_transition_series(spark, sf_dir):
    return bouts.transitions(event_bouts(spark, sf_dir), IDS, per_id=False).where("transition_count > 0")


# windows over frames


@query(sql(E, "SELECT event_id, round((x - lag(x) OVER w) * 30, 6) + 0.0 AS change FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)"))
def calculate_change_over_time(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(smoothing.change_over_time("x", IDS, fps=FPS)).alias("change"))


@query(sql(E, "SELECT event_id, round(sqrt(pow((x - lag(x) OVER w) * 30, 2) + pow((y - lag(y) OVER w) * 30, 2)), 6) AS speed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)"))
def calculate_speed_2d(spark, sf_dir):
    return smoothing.velocity_2d(events(spark, sf_dir), "x", "y", IDS, fps=FPS).select("event_id", r6("speed").alias("speed"))


@query(sql(E, "SELECT event_id, round(((y - lag(y) OVER w + 180) - floor((y - lag(y) OVER w + 180) / 360) * 360 - 180) * 30, 6) + 0.0 AS speed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)"))
def calculate_angular_speed(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(smoothing.angular_speed("y", IDS, radians=False, fps=FPS)).alias("speed"))


@query(sql(E, "SELECT event_id, array_to_string([event_type, lead(event_type) OVER w, lead(event_type, 2) OVER w], '>') AS sequence FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)"))
def get_syllable_sequence_series(spark, sf_dir):
    found = smoothing.value_sequences(events(spark, sf_dir), "event_type", IDS, after=2)
    return found.select("event_id", F.array_join("sequence", ">").alias("sequence"))


@query("SELECT event_id, CAST(round_even(value / (1000 / 30.0), 0) AS BIGINT) AS frame_index FROM events")
def get_actual_frame_indices(spark, sf_dir):
    return smoothing.true_frames(table(spark, sf_dir, "events").select("event_id", "value"), "value", FPS).select("event_id", "frame_index")


# keys


@query("SELECT DISTINCT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def get_list_union(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return align.key_union([orders, customers], ["key"])


@query("SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer")
def get_list_intersection(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return align.key_intersection([orders, customers], ["key"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS position FROM orders")
def get_alignment_index(spark, sf_dir):
    return align.positions_in(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"]).select("o_orderkey", F.col("position").cast("int").alias("position"))


@query(sql(E, """SELECT r.user_id, r.frame_index AS reference_frame_index, CAST(o.o AS BIGINT) AS frame_index, e.x
FROM (SELECT user_id, frame_index FROM e WHERE event_type = 'purchase') r CROSS JOIN (SELECT unnest(range(-2, 4)) AS o) o LEFT JOIN e ON e.user_id = r.user_id AND e.frame_index = r.frame_index + o.o"""))
def extract_subtrack_df(spark, sf_dir):
    track = events(spark, sf_dir)
    return align.subtracks(track, track.where("event_type = 'purchase'"), IDS, ["x"], 2, 3)


@query(sql(ISLANDS, "SELECT user_id, min(frame_index) AS index_start, max(frame_index) AS index_end, count(*) AS length FROM g WHERE on_ = 1 GROUP BY user_id, part"))
def boolean_series_to_chunks(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("on_", F.col("value") > 100)
    return runs.value_chunks(rows, "on_", IDS, skip_values=(False,)).select("user_id", "index_start", "index_end", "length")


BYTES = "s AS (SELECT o_orderkey, o_orderkey * 1000003 AS n FROM orders), i AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(log2(n) / 10) AS INT) ELSE 0 END AS i FROM s)"


@query(sql(BYTES, "SELECT o_orderkey, CASE WHEN n = 0 THEN '0B' ELSE CAST(round(n / pow(1024.0, i), 2) AS VARCHAR) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][i + 1] END AS size FROM i"))
def convert_bytes_to_string(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.readable_bytes(F.col("o_orderkey") * 1000003).alias("size"))


@query("""WITH w AS (SELECT p_partkey, i AS start, substr(p_name, i + 1, 3) AS part FROM (SELECT p_partkey, p_name, CAST(unnest(range(0, length(p_name) - 2)) AS INTEGER) AS i FROM part WHERE length(p_name) >= 3)),
m AS (SELECT *, CAST(part[1] <> 'r' AS INT) + CAST(part[2] <> 'e' AS INT) + CAST(part[3] <> 'd' AS INT) AS n_wrong FROM w) SELECT p_partkey, start, part, n_wrong FROM m WHERE n_wrong <= 1""")
def apply_close_match(spark, sf_dir):
    letters = F.filter(F.split("p_name", ""), lambda c: c != "")
    found = arrays.hamming_matches(letters, F.array(*map(F.lit, "red")), 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("m"))
    return rows.select("p_partkey", F.col("m.start").alias("start"), F.array_join("m.window", "").alias("part"), F.size("m.wrong").alias("n_wrong"))
