"""Queries on maps compared, graphs of pairs, skeletons, sampled bouts, flat keys and columns, and tracks in their variants."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.functions import arrays, columns, geometry, raster
from ethoframe.operators import align, bouts, networks, patterns, records, smoothing, tracks
from ethoframe.plans.frame_queries import _TRACK, _TWO, _Z, _track
from ethoframe.plans.inputs import BOUTS, E, FRAME, IDS, event_bouts, events, r6, sql, table
from ethoframe.plans.registry import query
from ethoframe.plans.structure_queries import _scratch
from ethoframe.sources import sqlite

# maps: each order's quantities by line number, compared over the orders of a customer

_MAPS = "o AS (SELECT o_custkey, o_orderkey FROM orders), m AS (SELECT o_custkey, o_orderkey, CAST(l_linenumber AS VARCHAR) AS key, l_quantity AS q FROM o JOIN lineitem ON l_orderkey = o_orderkey)"


def _order_maps(spark, sf_dir):
    """An order without lines has an empty map."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("key")).agg(F.max("l_quantity").alias("q"))
    maps = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("key", "q"))).alias("quantities"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(maps, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(
    sql(
        _MAPS,
        """, d AS (SELECT o_custkey, o_orderkey, key, max(q) AS q FROM m GROUP BY ALL), t AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey)
        SELECT d.o_custkey, key, count(*) AS n_holding, count(*) = n AS shared, count(*) = n AND count(DISTINCT q) = 1 AS common, count(*) = n AND count(DISTINCT q) > 1 AS variable,
               CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS owner FROM d JOIN t USING (o_custkey) GROUP BY d.o_custkey, key, n""",
    )
)
def check_dict_equality(spark, sf_dir):
    return records.key_agreement(_order_maps(spark, sf_dir), ["o_custkey"], "o_orderkey", "quantities")


@query(sql(_MAPS, "SELECT o_custkey, key, string_agg(CAST(CAST(q AS BIGINT) AS VARCHAR), ',' ORDER BY o_orderkey) AS quantities FROM (SELECT o_custkey, o_orderkey, key, max(q) AS q FROM m GROUP BY ALL) GROUP BY ALL"))
def dicts_to_dict_of_tuples(spark, sf_dir):
    found = records.values_by_key(_order_maps(spark, sf_dir), ["o_custkey"], "o_orderkey", "quantities")
    return found.select("o_custkey", "key", F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("quantities"))


# graphs: parts that follow each other within an order


_FOLLOW = """f AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS next_part, l_quantity, l_extendedprice FROM lineitem),
g AS (SELECT least(part, next_part) AS node_0, greatest(part, next_part) AS node_1, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity, l_extendedprice)) AS weight FROM f WHERE next_part IS NOT NULL GROUP BY ALL)"""
_PLACE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def _followers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", *_PLACE)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    pairs = lines.withColumns({"next_part": F.lead("l_partkey").over(w), "weight": F.col("l_quantity")})
    return networks.graph_edges(pairs, ("l_partkey", "next_part"), ["weight"], _PLACE)


@query(sql(_FOLLOW, "SELECT * FROM g"))
def pair_dict_to_network_graph(spark, sf_dir):
    return _followers(spark, sf_dir)


@query(
    sql(
        _FOLLOW,
        """SELECT node, count(*) AS degree, count(*) FILTER (away) AS out_degree, count(*) FILTER (NOT away) AS in_degree, CAST(sum(w) AS DOUBLE) AS weight
        FROM (SELECT node_0 AS node, true AS away, weight AS w FROM g UNION ALL SELECT node_1, false, CASE WHEN node_0 <> node_1 THEN weight END FROM g) GROUP BY node""",
    )
)
def network_nodes(spark, sf_dir):
    found = networks.graph_nodes(_followers(spark, sf_dir), "weight")
    return found.withColumn("weight", F.col("weight").cast("double"))


# skeletons: an order's lines are keypoints, each with an edge to the next line number


@query(
    sql(
        "l AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + 1 AS b FROM lineitem)",
        """SELECT l_orderkey, count(*) AS edges, 0::BIGINT AS null_indices, (SELECT count(*) FROM (SELECT a FROM l k WHERE k.l_orderkey = l.l_orderkey GROUP BY a HAVING count(*) > 1)) AS repeated_indices, 0::BIGINT AS loops, count(*) FILTER (NOT EXISTS (SELECT 1 FROM l k WHERE k.l_orderkey = l.l_orderkey AND k.a = l.b)) AS unknown_ends FROM l GROUP BY l_orderkey""",
    )
)
def check_skeleton_df(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("keypoint_name"))
    edges = lines.select("l_orderkey", F.col("keypoint_name").alias("edge_index"), F.col("keypoint_name").alias("node_0"), (F.col("keypoint_name") + 1).alias("node_1"))
    return tracks.skeleton_validity(edges, lines, ["l_orderkey"])


@query(sql(_TRACK, "SELECT a.frame_index, a.keypoint_name AS edge_index, round(a.x, 6) AS x_0, round(a.y, 6) AS y_0, round(b.x, 6) AS x_1, round(b.y, 6) AS y_1 FROM t a JOIN t b ON a.frame_index = b.frame_index AND b.keypoint_name = a.keypoint_name + 1"))
def plot_keypoint_skeleton(spark, sf_dir):
    """The lines that the picture draws."""
    track = _track(spark, sf_dir)
    # one row per keypoint name: the names are the keypoints of a skeleton
    edges = track.select(F.col("keypoint_name").alias("edge_index"), F.col("keypoint_name").alias("node_0"), (F.col("keypoint_name") + 1).alias("node_1")).distinct()
    return tracks.skeleton_edges(track, edges, [FRAME]).select(FRAME, "edge_index", *(r6(c).alias(c) for c in ("x_0", "y_0", "x_1", "y_1")))


# bouts, transitions


@query(sql(BOUTS, "SELECT DISTINCT user_id, frame_index, CAST(NULL AS BIGINT) AS end_frame, CAST(NULL AS BIGINT) AS bout_length, behavior_name FROM b"))
def sampled_trajectories_to_bout_df(spark, sf_dir):
    """The frames around every onset, taken back to bouts."""
    onsets = event_bouts(spark, sf_dir).select("user_id", FRAME, "behavior_name")
    around = align.neighbourhoods(events(spark, sf_dir), onsets, IDS, ["x", "y"], before=2, after=3)
    labelled = around.join(onsets.withColumnRenamed(FRAME, "reference_frame_index"), [*IDS, "reference_frame_index"])
    return bouts.sampled_bouts(labelled, IDS, "behavior_name", "reference_frame_index")


@query(
    sql(
        E,
        """, p AS (SELECT [lag(event_type) OVER w, event_type] AS a, [event_type, lead(event_type) OVER w] AS b, lag(frame_index) OVER w IS NOT NULL AND lead(frame_index) OVER w IS NOT NULL AS whole FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index))
        SELECT CASE WHEN a[1] IS NOT DISTINCT FROM a[2] THEN coalesce(a[1], '?') ELSE coalesce(a[1], '?') || ',' || coalesce(a[2], '?') END AS origin,
               CASE WHEN b[1] IS NOT DISTINCT FROM b[2] THEN coalesce(b[1], '?') ELSE coalesce(b[1], '?') || ',' || coalesce(b[2], '?') END AS target, count(*) AS n FROM p WHERE whole GROUP BY ALL""",
    )
)
def reduce_transition_series_index(spark, sf_dir):
    """Transitions between pairs of labels; a pair of one label is that label."""
    w = Window.partitionBy(*IDS).orderBy(FRAME)
    pairs = events(spark, sf_dir).select(F.array(F.lag("event_type").over(w), "event_type").alias("a"), F.array("event_type", F.lead("event_type").over(w)).alias("b"), (F.lag(FRAME).over(w).isNotNull() & F.lead(FRAME).over(w).isNotNull()).alias("whole"))
    name = lambda c: F.array_join(arrays.collapse_constant(F.col(c)), ",", "?")
    return pairs.where("whole").groupBy(name("a").alias("origin"), name("b").alias("target")).agg(F.count("*").alias("n"))


# flat keys and columns


def _by_type(spark, sf_dir):
    """Users with a nested column for each of two labels."""
    stats = lambda b: F.struct(F.count_if(F.col("event_type") == b).alias("n"), F.struct(r6(F.min(F.when(F.col("event_type") == b, F.col("value")))).alias("low"), r6(F.max(F.when(F.col("event_type") == b, F.col("value")))).alias("high")).alias("value")).alias(b)
    return events(spark, sf_dir).groupBy("user_id", F.pmod("event_id", F.lit(3)).alias("part")).agg(stats("click"), stats("view"))


_FLAT = ", ".join(f"""count(*) FILTER (event_type = '{b}') AS "{b}/n", round(min(value) FILTER (event_type = '{b}'), 6) + 0.0 AS "{b}/value/low", round(max(value) FILTER (event_type = '{b}'), 6) + 0.0 AS "{b}/value/high" """ for b in ("click", "view"))


@query(sql(E, f"SELECT user_id, event_id % 3 AS part, {_FLAT} FROM e GROUP BY user_id, event_id % 3"))
def pd_flatten_tuple_column_names(spark, sf_dir):
    return columns.flatten_columns(_by_type(spark, sf_dir))


@query(sql(E, f"SELECT CAST(user_id AS VARCHAR) || '|' || CAST(event_id % 3 AS VARCHAR) AS key, {_FLAT} FROM e GROUP BY user_id, event_id % 3"))
def pd_flatten_indices(spark, sf_dir):
    flat = columns.flatten_keys(_by_type(spark, sf_dir), ["user_id", "part"])
    return flat.withColumn("key", F.concat_ws("|", "key.user_id", "key.part"))


# variants


@query(sql(E, _Z + " SELECT user_id, frame_index, coalesce(abs(zs) >= 3.5, false) AS outlier FROM z"))
def get_modified_zscore_filter(spark, sf_dir):
    return smoothing.zscore_outliers(events(spark, sf_dir), "value", IDS).select("user_id", FRAME, "outlier")


@query("SELECT a.k AS key, q AS quantity, p AS price FROM (SELECT l_orderkey AS k FROM lineitem UNION SELECT o_orderkey FROM orders) a LEFT JOIN (SELECT l_orderkey AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1) b ON a.k = b.k LEFT JOIN (SELECT o_orderkey AS k, max(o_totalprice) AS p FROM orders GROUP BY 1) c ON a.k = c.k")
def pd_reindex_dict_values_to_index_union(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_quantity").alias("quantity"))
    prices = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("key")).agg(F.max("o_totalprice").alias("price"))
    one, two = align.reindex_to_union([lines, prices], ["key"])
    return one.select("key", "quantity").join(two.select("key", "price"), "key")


@query(sql(_TRACK, _TWO + " SELECT frame_index, round(ax, 6) AS x, round(ay, 6) AS y, round(degrees(atan2(by_ - ay, bx - ax)), 5) + 0.0 AS heading FROM p"))
def track_to_norm_df(spark, sf_dir):
    norm = tracks.norm_frames(_track(spark, sf_dir), [], 2, 1)
    return norm.select(FRAME, r6("x").alias("x"), r6("y").alias("y"), (F.round("heading", 5) + F.lit(0.0)).alias("heading"))


@query(sql(_TRACK, "SELECT frame_index, keypoint_name, round(0.5 * x - 0.25 * y + 3, 6) + 0.0 AS x, round(2 * x + 0.125 * y - 7, 6) + 0.0 AS y FROM t"))
def apply_transform_matrix_to_track_df(spark, sf_dir):
    moved = tracks.transform_track(_track(spark, sf_dir), [[0.5, -0.25, 3.0], [2.0, 0.125, -7.0]])
    return moved.select(FRAME, "keypoint_name", r6("x").alias("x"), r6("y").alias("y"))


@query("""SELECT count(*) AS "rows", 0::BIGINT AS null_keys, 0::BIGINT AS half_points, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_keys FROM lineitem""")
def check_track_df(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(FRAME), F.col("l_linenumber").alias("keypoint_name"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return tracks.track_validity(lines, [])


@query(
    sql(
        E,
        """SELECT user_id, event_type, frame_index // 5 AS frame_index, count(*) AS occupancy, arg_min(sparse, event_id) FILTER (sparse IS NOT NULL) AS sparse, arg_min(y, event_id) FILTER (y IS NOT NULL) AS y
        FROM e GROUP BY user_id, event_type, frame_index // 5""",
    )
)
def create_sleap_track_union(spark, sf_dir):
    """Rows of five frames at a time as tracks of one name, each event a track."""
    rows = events(spark, sf_dir).withColumns({"track_index": F.col("event_id"), FRAME: F.floor(F.col(FRAME) / 5)})
    return tracks.merge_tracks(rows, "event_type", IDS, ["sparse", "y"])


# trajectories: the frames around every onset, with the events' number modulo 3 as keypoint

_AROUND = """, j AS (SELECT b.behavior_name AS label, e.frame_index - b.frame_index AS step, e.event_id % 3 AS keypoint_name, e.x, e.y FROM b JOIN e ON e.user_id = b.user_id AND e.frame_index BETWEEN b.frame_index - 1 AND b.frame_index + 2),
m AS (SELECT label, step, keypoint_name, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y, count(*) AS n FROM j GROUP BY ALL)"""


def _medians(spark, sf_dir):
    onsets = event_bouts(spark, sf_dir).select("user_id", FRAME, F.col("behavior_name").alias("label"))
    around = align.neighbourhoods(events(spark, sf_dir), onsets, IDS, ["event_id", "x", "y"], before=1, after=2).where("event_id IS NOT NULL")
    labelled = around.join(onsets.withColumnRenamed(FRAME, "reference_frame_index"), [*IDS, "reference_frame_index"])
    named = labelled.select("label", F.col("offset").cast("long").alias("step"), F.pmod("event_id", F.lit(3)).alias("keypoint_name"), "x", "y")
    return tracks.trajectory_medians(named, "label", "step")


@query(sql(BOUTS, _AROUND + " SELECT label, step, keypoint_name, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, n FROM m"))
def trajectory_to_median_df(spark, sf_dir):
    return _medians(spark, sf_dir).select("label", "step", "keypoint_name", r6("x").alias("x"), r6("y").alias("y"), "n")


@query(
    sql(
        BOUTS,
        _AROUND
        + """, cells AS (SELECT l.label, s.step, k.keypoint_name, m.n IS NOT NULL AS seen FROM (SELECT DISTINCT label FROM m) l, (SELECT DISTINCT step FROM m) s, (SELECT DISTINCT keypoint_name FROM m) k
             LEFT JOIN m ON m.label = l.label AND m.step = s.step AND m.keypoint_name = k.keypoint_name)
        SELECT label, bool_and(seen) AS complete FROM cells GROUP BY label""",
    )
)
def trajectory_median_full_index_check(spark, sf_dir):
    return tracks.complete_medians(_medians(spark, sf_dir), "label", "step", keypoints="all", steps="all")


# windows


@query(sql(E, ", c AS (SELECT event_type = 'view' AND lead(event_type) OVER w = 'click' AS occurs, user_id, frame_index, event_type IS NOT NULL AND lead(event_type) OVER w IS NOT NULL AS whole FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)) SELECT user_id, frame_index, occurs FROM c WHERE whole"))
def get_single_sequence_occurrence_series(spark, sf_dir):
    return patterns.sequence_occurrences(events(spark, sf_dir), "event_type", [["view", "click"]], IDS).select("user_id", FRAME, "occurs")


@query(
    sql(
        E,
        """, r AS (SELECT user_id, frame_index, CAST(unnest(range(-1, 4)) AS BIGINT) AS "offset" FROM e WHERE event_type = 'error')
        SELECT r.user_id, r.frame_index AS reference_frame_index, r."offset", e.value FROM r LEFT JOIN e ON e.user_id = r.user_id AND e.frame_index = r.frame_index + r."offset" """,
    )
)
def extract_series_neighbourhood_df(spark, sf_dir):
    rows = events(spark, sf_dir)
    return align.neighbourhoods(rows, rows.where("event_type = 'error'"), IDS, ["value"], before=1, after=3)


@query(
    sql(
        E,
        """, t AS (SELECT DISTINCT user_id, CAST(round_even(((frame_index * 2 - frame_index % 3) * 1000 / 30.0) / (1000 / 30.0), 0) AS BIGINT) AS f FROM e), u AS (SELECT user_id, CAST(unnest(range(1, max(f) + 1)) AS BIGINT) AS frame_index FROM t GROUP BY user_id)
        SELECT u.user_id, u.frame_index, t.f IS NULL AS skipped FROM u LEFT JOIN t ON t.user_id = u.user_id AND t.f = u.frame_index""",
    )
)
def get_frame_skipped_series(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("msec", (F.col(FRAME) * 2 - F.col(FRAME) % 3) * 1000 / F.lit(30.0))
    return smoothing.frame_presence(rows, "msec", IDS, 30.0).select("user_id", FRAME, (~F.col("present")).alias("skipped"))


# boxes and cells: lines of an order


@query("""SELECT l_orderkey, l_linenumber, greatest(l_quantity, 10) AS x, greatest(l_linenumber, 2)::DOUBLE AS y, least(l_quantity + 20, 40) - greatest(l_quantity, 10) AS w, least(l_linenumber + 3, 6)::DOUBLE - greatest(l_linenumber, 2) AS h
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) WHERE l_quantity + 20 > 10 AND l_quantity < 40 AND l_linenumber < 6 AND l_linenumber + 3 > 2""")
def fit_bbox_to_limits(spark, sf_dir):
    """Boxes cut to limits; those outside have no row here."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct()
    box = geometry.box(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(20.0), F.lit(3.0))
    limits = geometry.box(F.lit(10.0), F.lit(2.0), F.lit(30.0), F.lit(4.0))
    cut = lines.where("l_quantity < 40 AND l_linenumber < 6").withColumn("b", geometry.clip_box(box, limits, error=False))
    return cut.where("b IS NOT NULL").select("l_orderkey", "l_linenumber", *(F.col(f"b.{c}").alias(c) for c in "xywh"))


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS r, l_suppkey % 7 AS c FROM lineitem), s AS (SELECT CAST(unnest(range(-1, 2)) AS BIGINT) AS d),
    d AS (SELECT DISTINCT k, r + a.d AS r, c + b.d AS c FROM c, s a, s b), e AS (SELECT k, r + a.d AS r, c + b.d AS c, count(*) AS n FROM d, s a, s b GROUP BY ALL)
    SELECT k AS l_orderkey, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS col FROM e WHERE n = 9"""
)
def clean_raster(spark, sf_dir):
    """A mask of an order's lines and suppliers, dilated and eroded."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("row"), F.pmod("l_suppkey", F.lit(7)).cast("long").alias("col"))
    return raster.clean(cells, ["l_orderkey"])


# databases


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def sqlite_between_query(spark, sf_dir):
    """All orders written, those within limits read; the database gets the limits."""
    path = urlparse(_scratch(spark, "priced-orders")).path + ".db"
    sqlite.write_sqlite_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path, "orders")
    return sqlite.read_sqlite_table(spark, path, "orders").where(F.col("o_totalprice").between(100000.0, 200000.0))


@query("SELECT n_nationkey, n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def read_sqlite(spark, sf_dir):
    """Three tables written into one database and read back together."""
    path = urlparse(_scratch(spark, "nations")).path + ".db"
    of = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    sqlite.write_sqlite({"nation": of("nation", "n_nationkey", "n_name", "n_regionkey"), "region": of("region", "r_regionkey", "r_name"), "customer": of("customer", "c_custkey", "c_nationkey")}, path)
    found = sqlite.read_sqlite(spark, path)
    named = found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return named.join(found["customer"], F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name", "r_name").agg(F.count("c_custkey").alias("customers"))
