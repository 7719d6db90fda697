"""Queries on windows, kinematics, alignment, tracks and vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ethoframe.frames import frame_numbers
from ethoframe.functions import angles, geometry
from ethoframe.operators import align, selection, smoothing, tracks, vectors
from ethoframe.plans.inputs import E, FPS, FRAME, IDS, events, r6, sql, table
from ethoframe.plans.registry import query

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)"


@query(sql(E, "SELECT user_id, frame_index, CASE WHEN count(sparse) OVER f = 3 THEN round(avg(sparse) OVER f, 6) END AS sparse_mean FROM e WINDOW f AS (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))
def pd_smooth_series(spark, sf_dir):
    return smoothing.smooth(events(spark, sf_dir), "sparse", IDS).select("user_id", FRAME, r6("sparse_mean").alias("sparse_mean"))


@query(
    sql(
        E,
        """SELECT user_id, frame_index, CASE WHEN count(value) OVER f = 5 THEN round(quantile_cont(value, 0.5) OVER f, 6) END AS value_median,
        CASE WHEN count(y) OVER h = 3 THEN max(y) OVER h END AS y_max FROM e
        WINDOW f AS (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), h AS (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    )
)
def pd_smooth_df(spark, sf_dir):
    out = smoothing.smooth_columns(events(spark, sf_dir), {"value": {"size": 5, "stat": "median"}, "y": {"size": 3, "stat": "max"}}, IDS)
    return out.select("user_id", FRAME, r6("value_median").alias("value_median"), "y_max")


@query(
    sql(
        E,
        """, d AS (SELECT *, value - quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS dev FROM e),
        m AS (SELECT *, quantile_cont(abs(dev), 0.5) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mad FROM d)
        SELECT user_id, frame_index, round(CASE WHEN mad <> 0 THEN 0.6745 * dev / mad END, 6) + 0.0 AS zscore FROM m""",
    )
)
def get_rolling_modified_zscore_filter(spark, sf_dir):
    return smoothing.rolling_zscore(events(spark, sf_dir), "value", IDS).select("user_id", FRAME, r6("zscore").alias("zscore"))


_Z = """, c AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM e GROUP BY user_id), s AS (SELECT user_id, quantile_cont(abs(value - med), 0.5) AS mad FROM e JOIN c USING (user_id) GROUP BY user_id),
  z AS (SELECT *, CASE WHEN mad <> 0 THEN 0.6745 * (value - med) / mad END AS zs FROM e JOIN c USING (user_id) JOIN s USING (user_id))"""


@query(sql(E, _Z + " SELECT user_id, frame_index, round(zs, 6) + 0.0 AS zscore FROM z"))
def get_modified_zscore(spark, sf_dir):
    return smoothing.modified_zscore(events(spark, sf_dir), "value", IDS).select("user_id", FRAME, r6("zscore").alias("zscore"))


@query(sql(E, _Z + " SELECT user_id, frame_index, CASE WHEN NOT coalesce(abs(zs) >= 3.5, false) THEN value END AS value FROM z"))
def filter_series_by_modified_zscore(spark, sf_dir):
    return smoothing.drop_zscore_outliers(events(spark, sf_dir), "value", IDS).select("user_id", FRAME, "value")


@query(
    sql(
        E,
        """, p AS (SELECT *, max(CASE WHEN sparse IS NOT NULL THEN frame_index END) OVER (PARTITION BY user_id ORDER BY frame_index) AS pi,
                  min(CASE WHEN sparse IS NOT NULL THEN frame_index END) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM e)
        SELECT p.user_id, p.frame_index, round(coalesce(p.sparse, CASE WHEN ni - pi - 1 <= 1 THEN a.sparse + (b.sparse - a.sparse) * (p.frame_index - pi) / (ni - pi) END), 6) AS sparse
        FROM p LEFT JOIN e a ON a.user_id = p.user_id AND a.frame_index = p.pi LEFT JOIN e b ON b.user_id = p.user_id AND b.frame_index = p.ni""",
    )
)
def pd_limited_interpolation_series(spark, sf_dir):
    return smoothing.interpolate(events(spark, sf_dir), "sparse", IDS, limit=1).select("user_id", FRAME, r6("sparse").alias("sparse"))


@query(sql(E, f"SELECT user_id, frame_index, round((value - lag(value) OVER w) * {FPS}, 6) + 0.0 AS speed FROM e {_W}"))
def calculate_speed_1d(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", FRAME, r6(smoothing.change_over_time("value", IDS, fps=FPS)).alias("speed"))


@query(sql(E, f", v AS (SELECT *, (value - lag(value) OVER w) * {FPS} AS v FROM e {_W}) SELECT user_id, frame_index, round((v - lag(v) OVER w) * {FPS}, 6) + 0.0 AS acceleration FROM v {_W}"))
def calculate_acceleration_1d(spark, sf_dir):
    return smoothing.acceleration(events(spark, sf_dir), "value", IDS, fps=FPS).select("user_id", FRAME, r6("acceleration").alias("acceleration"))


_V2 = f", v AS (SELECT *, (x - lag(x) OVER w) * {FPS} AS vx, (y - lag(y) OVER w) * {FPS} AS vy FROM e {_W})"


@query(sql(E, _V2 + " SELECT user_id, frame_index, round(sqrt(vx * vx + vy * vy), 6) AS speed, round(atan2(vy, vx), 6) + 0.0 AS direction FROM v"))
def calculate_velocity_2d(spark, sf_dir):
    return smoothing.velocity_2d(events(spark, sf_dir), "x", "y", IDS, fps=FPS).select("user_id", FRAME, r6("speed").alias("speed"), r6("direction").alias("direction"))


@query(sql(E, _V2 + f", a AS (SELECT *, (vx - lag(vx) OVER w) * {FPS} AS ax, (vy - lag(vy) OVER w) * {FPS} AS ay FROM v {_W}) SELECT user_id, frame_index, round(sqrt(ax * ax + ay * ay), 5) AS acceleration FROM a"))
def calculate_acceleration_2d(spark, sf_dir):
    return smoothing.acceleration_2d(events(spark, sf_dir), "x", "y", IDS, fps=FPS).select("user_id", FRAME, F.round("acceleration", 5).alias("acceleration"))


_PMOD = lambda a, m: f"(({a}) - {m} * floor(({a}) / {m}))"


@query(sql(E, f", d AS (SELECT user_id, frame_index, value * 7 - lag(value * 7) OVER w + 180 AS a FROM e {_W}) SELECT user_id, frame_index, round({_PMOD('a', 360)} - 180, 6) + 0.0 AS turn FROM d"))
def angular_diff(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("angle", F.col("value") * 7)
    return rows.select("user_id", FRAME, r6(smoothing.angular_change("angle", IDS, radians=False)).alias("turn"))


@query(sql(E, f"SELECT event_id, round({_PMOD('value * 13 + 180', 360)} - 180, 6) + 0.0 AS angle FROM e"))
def normalize_angle(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(angles.normalize_angle(F.col("value") * 13)).alias("angle"))


@query(sql(E, "SELECT event_id, round(sqrt(x * x + y * y), 6) AS rho, round(atan2(y, x), 6) + 0.0 AS phi FROM e"))
def cart2pol(spark, sf_dir):
    p = angles.polar(F.col("x"), F.col("y"))
    return events(spark, sf_dir).select("event_id", r6(p["rho"]).alias("rho"), r6(p["phi"]).alias("phi"))


@query(sql(E, "SELECT event_id, round(x * cos(y), 6) + 0.0 AS px, round(x * sin(y), 6) + 0.0 AS py FROM e"))
def pol2cart(spark, sf_dir):
    p = angles.cartesian(F.col("x"), F.col("y"))
    return events(spark, sf_dir).select("event_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


@query(sql(E, "SELECT event_id, round((x - 3) * cos(0.5) - (y - 4) * sin(0.5) + 3, 6) + 0.0 AS rx, round((x - 3) * sin(0.5) + (y - 4) * cos(0.5) + 4, 6) + 0.0 AS ry FROM e"))
def rotate_2d_point_groups_np(spark, sf_dir):
    p = angles.rotate(F.col("x"), F.col("y"), F.lit(0.5), F.lit(3.0), F.lit(4.0))
    return events(spark, sf_dir).select("event_id", r6(p["x"]).alias("rx"), r6(p["y"]).alias("ry"))


@query(sql(E, "SELECT event_id, round(2 * x + 0.5 * y - 7, 6) + 0.0 AS tx, round(-x + 3 * y + 1, 6) + 0.0 AS ty FROM e"))
def apply_2d_affine_transform(spark, sf_dir):
    p = angles.affine(F.col("x"), F.col("y"), [[2, 0.5, -7], [-1, 3, 1]])
    return events(spark, sf_dir).select("event_id", r6(p["x"]).alias("tx"), r6(p["y"]).alias("ty"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY ALL")
def get_linear_transform(spark, sf_dir):
    slope, intercept = angles.linear_fit(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(slope, 4).alias("slope"), F.round(intercept, 4).alias("intercept"))


@query(sql(E, f"SELECT user_id, frame_index, lag(event_type) OVER w || '|' || event_type || '|' || lead(event_type) OVER w AS sequence FROM e {_W} QUALIFY sequence IS NOT NULL"))
def get_value_sequence(spark, sf_dir):
    out = smoothing.value_sequences(events(spark, sf_dir), "event_type", IDS, before=1, after=1, keep_null=False)
    return out.select("user_id", FRAME, F.array_join("sequence", "|").alias("sequence"))


_MS = "(frame_index * 2 - frame_index % 3) * 1000 / 30.0"


@query(sql(E, f", t AS (SELECT *, CAST(round_even({_MS} / (1000 / 30.0), 0) AS BIGINT) AS f FROM e) SELECT user_id, frame_index, CAST(coalesce(f - lag(f) OVER w - 1, 0) AS BIGINT) AS skipped FROM t {_W}"))
def count_frame_skips(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("msec", (F.col(FRAME) * 2 - F.col(FRAME) % 3) * 1000 / F.lit(30.0))
    return smoothing.frame_skips(rows, "msec", IDS, FRAME, FPS).select("user_id", FRAME, "skipped")


@query(
    sql(
        E,
        f""", t AS (SELECT DISTINCT user_id, CAST(round_even({_MS} / (1000 / 30.0), 0) AS BIGINT) AS f FROM e), u AS (SELECT user_id, CAST(unnest(range(1, max(f) + 1)) AS BIGINT) AS frame_index FROM t GROUP BY user_id)
        SELECT u.user_id, u.frame_index, t.f IS NOT NULL AS present FROM u LEFT JOIN t ON t.user_id = u.user_id AND t.f = u.frame_index""",
    )
)
def get_frame_exists_series(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("msec", (F.col(FRAME) * 2 - F.col(FRAME) % 3) * 1000 / F.lit(30.0))
    return smoothing.frame_presence(rows, "msec", IDS, FPS)


_REFS = ", refs AS (SELECT user_id, frame_index FROM e WHERE event_type = 'signup')"


@query(
    sql(
        E,
        _REFS
        + """, w AS (SELECT user_id, frame_index AS reference_frame_index, CAST(unnest(range(-2, 3)) AS BIGINT) AS "offset" FROM refs)
        SELECT w.user_id, w.reference_frame_index, w."offset", e.event_type, e.value FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.frame_index = w.reference_frame_index + w."offset" """,
    )
)
def extract_neighbourhood_df(spark, sf_dir):
    rows = events(spark, sf_dir)
    return align.neighbourhoods(rows, rows.where("event_type = 'signup'"), IDS, ["event_type", "value"], before=2, after=2)


@query(sql(E, ", k AS (SELECT user_id, frame_index FROM e WHERE event_type = 'purchase') SELECT e.user_id, e.frame_index, k.frame_index AS known_index FROM e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.frame_index >= k.frame_index"))
def get_most_recent_index(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", FRAME, "event_type")
    return align.as_of(rows, rows.where("event_type = 'purchase'"), IDS).select("user_id", FRAME, "known_index")


@query(
    sql(
        E,
        """, k AS (SELECT user_id, frame_index FROM e WHERE event_type = 'purchase'),
        b AS (SELECT e.user_id, e.frame_index, k.frame_index AS p FROM e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.frame_index >= k.frame_index),
        a AS (SELECT b.*, k.frame_index AS n FROM b ASOF LEFT JOIN k ON b.user_id = k.user_id AND b.frame_index <= k.frame_index)
        SELECT user_id, frame_index, CASE WHEN n IS NULL OR frame_index - p <= n - frame_index THEN p ELSE n END AS known_index FROM a""",
    )
)
def get_closest_value(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", FRAME, "event_type")
    return align.as_of(rows, rows.where("event_type = 'purchase'"), IDS, direction="closest").select("user_id", FRAME, "known_index")


@query("SELECT conv_id, CAST(unnest(range(min(turn), max(turn) + 1)) AS BIGINT) AS turn FROM conversations GROUP BY conv_id")
def get_full_frame_index(spark, sf_dir):
    from ethoframe.operators.runs import full_frames

    return full_frames(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT s.o_orderstatus, p.o_orderpriority, c.n FROM (SELECT DISTINCT o_orderstatus FROM c) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM c) p LEFT JOIN c ON c.o_orderstatus = s.o_orderstatus AND c.o_orderpriority = p.o_orderpriority"""
)
def reindex_df_to_col_product(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return align.product_index(counts, ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_custkey AS custkey FROM orders UNION SELECT c_custkey FROM customer")
def pd_get_index_union(spark, sf_dir):
    return align.key_union([table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))], ["custkey"])


@query("SELECT o_custkey AS custkey FROM orders INTERSECT SELECT c_custkey FROM customer")
def pd_get_index_intersection(spark, sf_dir):
    return align.key_intersection([table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))], ["custkey"])


@query("SELECT c.c_custkey AS custkey, coalesce(n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) o ON o.o_custkey = c.c_custkey")
def pd_reindex_to_index_union(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return align.reindex(counts, customers, ["custkey"], {"n": 0})


@query(
    """WITH c AS (SELECT n_name AS a, r_name AS b, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), l AS (SELECT a FROM c UNION SELECT b FROM c)
    SELECT x.a, y.a AS b, coalesce(c.n, 0) AS n FROM l x CROSS JOIN l y LEFT JOIN c ON c.a = x.a AND c.b = y.a"""
)
def pd_make_df_square(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return align.square(cells.groupBy(F.col("n_name").alias("a"), F.col("r_name").alias("b")).agg(F.count("*").alias("n")), "a", "b", "n", 0)


@query("SELECT CAST(i AS BIGINT) AS o_custkey FROM (SELECT unnest(range(min(o_custkey), max(o_custkey))) AS i FROM orders) WHERE i NOT IN (SELECT o_custkey FROM orders)")
def pd_missing_ints_in_list(spark, sf_dir):
    return align.missing_ints(table(spark, sf_dir, "orders"), "o_custkey")


_TRACK = "t AS (SELECT l_orderkey AS frame_index, l_linenumber AS keypoint_name, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL)"


def _track(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias(FRAME), F.col("l_linenumber").alias("keypoint_name"))
    return rows.agg(F.avg("l_quantity").alias("x"), F.avg("l_extendedprice").alias("y"))


@query(sql(_TRACK, "SELECT frame_index, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y FROM t GROUP BY ALL"))
def track_to_centroid_df(spark, sf_dir):
    return tracks.centroids(_track(spark, sf_dir), []).select(FRAME, r6("x").alias("x"), r6("y").alias("y"))


@query(sql(_TRACK, "SELECT keypoint_name, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y FROM t GROUP BY ALL"))
def aggregate_keypoint_df(spark, sf_dir):
    return tracks.keypoint_medians(_track(spark, sf_dir)).select("keypoint_name", r6("x").alias("x"), r6("y").alias("y"))


@query(
    sql(
        _TRACK,
        """, c AS (SELECT frame_index, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy FROM t GROUP BY ALL),
        s AS (SELECT keypoint_name, quantile_cont(abs(x - cx), 0.99) AS qx, quantile_cont(abs(y - cy), 0.99) AS qy FROM t JOIN c USING (frame_index) GROUP BY ALL), d AS (SELECT greatest(max(qx), max(qy)) * 1.05 AS side FROM s)
        SELECT frame_index, round(cx - floor(side / 2), 6) + 0.0 AS x, round(cy - floor(side / 2), 6) + 0.0 AS y, round(side, 6) AS w, round(side, 6) AS h FROM c CROSS JOIN d""",
    )
)
def track_to_roi_df(spark, sf_dir):
    return tracks.region_of_interest(_track(spark, sf_dir), []).select(FRAME, *(r6(c).alias(c) for c in "xywh"))


_TWO = ", p AS (SELECT a.frame_index, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM t a JOIN t b ON a.frame_index = b.frame_index AND a.keypoint_name = 1 AND b.keypoint_name = 2)"


@query(sql(_TRACK, _TWO + " SELECT frame_index, round(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 6) AS rho, round(degrees(atan2(by_ - ay, bx - ax)), 5) + 0.0 AS phi FROM p"))
def track_to_distance_orientation_df(spark, sf_dir):
    return tracks.keypoint_direction(_track(spark, sf_dir), [], 2, 1).where("rho IS NOT NULL").select(FRAME, r6("rho").alias("rho"), (F.round("phi", 5) + F.lit(0.0)).alias("phi"))


@query(
    sql(
        _TRACK,
        _TWO
        + """, n AS (SELECT frame_index, ax AS nx, ay AS ny, atan2(by_ - ay, bx - ax) AS h FROM p)
        SELECT frame_index, keypoint_name, round((x - nx) * cos(-h) - (y - ny) * sin(-h), 6) + 0.0 AS x, round((x - nx) * sin(-h) + (y - ny) * cos(-h), 6) + 0.0 AS y FROM t LEFT JOIN n USING (frame_index)""",
    )
)
def normalize_track_df(spark, sf_dir):
    track = _track(spark, sf_dir)
    out = tracks.normalise(track, tracks.norm_frames(track, [], 2, 1), [FRAME])
    return out.select(FRAME, "keypoint_name", r6("x").alias("x"), r6("y").alias("y"))


@query(sql(_TRACK, "SELECT keypoint_name, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x) - min(x), 6) AS w, round(max(y) - min(y), 6) AS h FROM t GROUP BY ALL"))
def get_points_bbox(spark, sf_dir):
    b = geometry.points_box(F.col("x"), F.col("y"))
    boxed = _track(spark, sf_dir).groupBy("keypoint_name").agg(b.alias("b"))
    return boxed.select("keypoint_name", *(r6(f"b.{c}").alias(c) for c in "xywh"))


@query(
    sql(
        _TRACK,
        """, b AS (SELECT frame_index, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM t GROUP BY ALL), n AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(w) OVER o AS w2, lead(h) OVER o AS h2 FROM b WINDOW o AS (ORDER BY frame_index))
        SELECT frame_index, x < x2 + w2 AND x2 < x + w AND y < y2 + h2 AND y2 < y + h AS overlaps FROM n WHERE x2 IS NOT NULL""",
    )
)
def check_bbox_intersection(spark, sf_dir):
    boxed = _track(spark, sf_dir).groupBy(FRAME).agg(geometry.points_box(F.col("x"), F.col("y")).alias("b"))
    # a query over one series: all frames are in one order
    ranked = frame_numbers(boxed, [], [FRAME], "n")
    after = ranked.select((F.col("n") - 1).alias("n"), F.col("b").alias("b2"))
    return ranked.join(after, "n").select(FRAME, geometry.boxes_overlap(F.col("b"), F.col("b2")).alias("overlaps"))


@query("SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label")
def get_group_sizes(spark, sf_dir):
    return vectors.group_sizes(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"])


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice FROM lineitem GROUP BY ALL")
def get_group_aggregate(spark, sf_dir):
    out = vectors.group_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", r6("l_quantity").alias("l_quantity"), r6("l_extendedprice").alias("l_extendedprice"))


@query("SELECT l_linestatus, round((avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') - avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R')) / stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag <> 'R'), 6) AS glass_delta FROM lineitem GROUP BY ALL")
def glass_delta(spark, sf_dir):
    out = vectors.glass_delta(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R", ["l_linestatus"])
    return out.select("l_linestatus", r6("glass_delta").alias("glass_delta"))


_CENTRES = "c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, quantile_cont(v, 0.5) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
_NEAREST = _CENTRES + ", d AS (SELECT vec_id, e.label, c.label AS closest, 1 - list_cosine_similarity(embedding::DOUBLE[], centroid) AS distance FROM embeddings e CROSS JOIN c), n AS (SELECT vec_id, label, arg_min(closest, distance) AS closest, min(distance) AS distance FROM d GROUP BY ALL)"


@query(sql(_CENTRES, "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(centroid[i], 6) AS m FROM (SELECT label, centroid, unnest(range(1, 65)) AS i FROM c)"))
def get_group_geometric_median(spark, sf_dir):
    return vectors.vector_medians(table(spark, sf_dir, "embeddings"), "embedding", ["label"]).select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", r6("m").alias("m"))


@query(sql(_NEAREST, "SELECT vec_id, label, closest, round(distance, 6) AS distance FROM n"))
def get_closest_centroid_df(spark, sf_dir):
    out = vectors.closest_centroids(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return out.select("vec_id", "label", "closest", r6("distance").alias("distance"))


@query(sql(_NEAREST, "SELECT x.label, y.closest, CAST(count(n.vec_id) AS BIGINT) AS n FROM (SELECT DISTINCT label FROM n) x CROSS JOIN (SELECT DISTINCT closest FROM n) y LEFT JOIN n ON n.label = x.label AND n.closest = y.closest GROUP BY ALL"))
def get_closest_centroid_confusion_matrix(spark, sf_dir):
    out = vectors.closest_centroids(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return vectors.confusion(out.select("label", "closest"), "label", "closest")


_PAIRS = "p AS (SELECT a.vec_id AS key_a, b.vec_id AS key_b, a.label, b.label AS other, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a CROSS JOIN embeddings b)"


@query(sql(_PAIRS, "SELECT key_a, other AS label, round(quantile_cont(distance, 0.5), 6) AS distance FROM p GROUP BY ALL"))
def get_aggregated_group_distance(spark, sf_dir):
    return vectors.distances_to_groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("key_a", "label", r6("distance").alias("distance"))


@query(sql(_CENTRES, "SELECT a.label AS key_a, b.label AS key_b, round(1 - list_cosine_similarity(a.centroid, b.centroid), 6) + 0.0 AS distance FROM c a JOIN c b ON a.label < b.label"))
def get_pairwise_distance(spark, sf_dir):
    medians = vectors.vector_medians(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return vectors.pairwise_distances(medians, medians, "label", "centroid", ordered_pairs=True).select("key_a", "key_b", r6("distance").alias("distance"))


@query(
    sql(
        _PAIRS,
        """, m AS (SELECT key_a, label, other, avg(distance) AS d FROM p WHERE key_a <> key_b GROUP BY ALL), s AS (SELECT key_a, label, max(d) FILTER (WHERE other = label) AS a, min(d) FILTER (WHERE other <> label) AS b FROM m GROUP BY ALL)
        SELECT key_a AS vec_id, label, round(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM s""",
    )
)
def get_silhouette_score_per_group(spark, sf_dir):
    out = vectors.silhouettes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select("vec_id", "label", r6("silhouette").alias("silhouette"))


@query("SELECT * FROM (SELECT 'l_quantity' AS column_a, 'l_discount' AS column_b, round(corr(l_quantity, l_discount), 6) + 0.0 AS value FROM lineitem UNION ALL SELECT 'l_discount', 'l_quantity', round(corr(l_quantity, l_discount), 6) + 0.0 FROM lineitem)")
def get_column_comparison_matrix(spark, sf_dir):
    return vectors.column_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]).withColumn("value", r6("value"))


@query(sql(E, "SELECT event_id, sqrt((x - 20) * (x - 20) + (y - 50) * (y - 50)) <= 30 AS inside FROM e"))
def check_trace_in_area(spark, sf_dir):
    from ethoframe.functions.raster import disc, mark

    return mark(events(spark, sf_dir), [disc(20, 50, 30)]).select("event_id", "inside")


@query(sql(E, "SELECT event_id, CASE WHEN x >= 0 AND x < 10 AND y >= 0 AND y < 40 THEN 'a' WHEN x >= 10 AND x < 25 AND y >= 0 AND y < 97 THEN 'b' END AS area FROM e"))
def get_arena_polygon_from_position(spark, sf_dir):
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    areas = spark.createDataFrame([("a", square(0.0, 0.0, 10.0, 40.0)), ("b", square(10.0, 0.0, 25.0, 97.0))], "name string, polygon array<struct<x: double, y: double>>")
    return geometry.label_points(events(spark, sf_dir), areas, 2).select("event_id", "area")


@query()
def filter_angle(spark, sf_dir):
    """Circular medians, checked against plain Python in the tests."""
    rows = events(spark, sf_dir).withColumn("angle", F.col("value") % F.lit(2 * math.pi))
    return smoothing.smooth_angle(rows, "angle", IDS, name="smooth").select("user_id", FRAME, r6("smooth").alias("smooth"))


@query()
def get_max_frequency(spark, sf_dir):
    return smoothing.dominant_frequency(events(spark, sf_dir), "value", IDS)


@query()
def linear_object_assignment(spark, sf_dir):
    """One small matching problem per user: event types to hours of their mean values; checked against permutations in the tests."""
    cells = events(spark, sf_dir).groupBy("user_id", "event_type", F.pmod(FRAME, F.lit(6)).alias("slot")).agg(F.avg("value").alias("cost"))
    return vectors.assign(cells, IDS, "event_type", "slot", "cost").withColumn("cost", r6("cost"))


_TRAILING = "PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"


@query(sql(E, f"SELECT user_id, frame_index, CASE WHEN count(value) OVER f = 4 THEN round(sum(value) OVER f, 6) + 0.0 END AS value_sum, CASE WHEN count(y) OVER f = 4 THEN min(y) OVER f END AS y_min FROM e WINDOW f AS ({_TRAILING})"))
def pd_rolling_df_factory(spark, sf_dir):
    options = {"value": {"size": 4, "stat": "sum", "center": False}, "y": {"size": 4, "stat": "min", "center": False}}
    out = smoothing.smooth_columns(events(spark, sf_dir), options, IDS)
    return out.select("user_id", FRAME, r6("value_sum").alias("value_sum"), "y_min")


@query(
    sql(
        E,
        """, m AS (SELECT user_id, frame_index AS i, CASE WHEN event_id % 7 <> 0 THEN frame_index * 40 + event_id % 3 END AS x FROM e),
        n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS p, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM m),
        g AS (SELECT n.user_id, n.i, CASE WHEN n.p = n.q THEN n.x ELSE a.x + (b.x - a.x) * (n.i - n.p) / (n.q - n.p) END AS y FROM n LEFT JOIN m a ON a.user_id = n.user_id AND a.i = n.p LEFT JOIN m b ON b.user_id = n.user_id AND b.i = n.q),
        d AS (SELECT user_id, min(i) AS f, max(i) AS l FROM m WHERE x IS NOT NULL GROUP BY user_id)
        SELECT g.user_id, g.i AS frame_index, round(CAST(CASE WHEN g.y IS NOT NULL THEN g.y WHEN g.i < f THEN f1.y + (g.i - f) * (f2.y - f1.y) ELSE l1.y + (g.i - l) * (l1.y - l2.y) END AS DOUBLE), 6) + 0.0 AS msec
        FROM g LEFT JOIN d ON d.user_id = g.user_id LEFT JOIN g f1 ON f1.user_id = d.user_id AND f1.i = f LEFT JOIN g f2 ON f2.user_id = d.user_id AND f2.i = f + 1
        LEFT JOIN g l1 ON l1.user_id = d.user_id AND l1.i = l LEFT JOIN g l2 ON l2.user_id = d.user_id AND l2.i = l - 1""",
    )
)
def fix_frame_msec_series(spark, sf_dir):
    msec = F.when(F.pmod("event_id", F.lit(7)) != 0, F.col(FRAME) * 40 + F.pmod("event_id", F.lit(3))).otherwise(F.lit(0))
    fixed = smoothing.fix_timestamps(events(spark, sf_dir).withColumn("raw", msec), "raw", IDS, FRAME)
    return fixed.select("user_id", FRAME, r6("msec").alias("msec"))
