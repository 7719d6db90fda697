"""Queries on assignments, disjoint sets, trees, JSON in texts, polygons, draws, segments, linkage, and folders and databases that are written and read back."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ethoframe.functions import trees
from ethoframe.operators import assignment, disjoint, draws, linkage, polygons, segments, vectors
from ethoframe.plans.inputs import E, IDS, events, sql, table
from ethoframe.plans.registry import query
from ethoframe.shared import shared_dir
from ethoframe.sources import files, sqlite

# assignment: lines of an order in three groups by line number; group 0 is the anchor


def _objects(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("g"), "l_quantity", F.round(F.col("l_extendedprice") * 100).alias("p"))
    item = F.concat_ws("|", F.format_string("%08.2f", F.col("l_quantity")), F.format_string("%012.0f", F.col("p")))
    return lines.select("l_orderkey", "g", item.alias("item"), F.array("l_quantity", "p").alias("v"))


def _matched(pick: str) -> str:
    """Every matching of the smaller side into the larger one, a row at a time."""
    return f"""WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_linenumber % 3 AS g, l_quantity AS q, round(l_extendedprice * 100) AS p FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY q, p) AS i, count(*) OVER (PARTITION BY k, g) AS n FROM l),
c AS (SELECT b.k, b.g, CASE WHEN a.n <= b.n THEN a.i ELSE b.i END AS r, CASE WHEN a.n <= b.n THEN b.i ELSE a.i END AS c, ((a.q - b.q) * (a.q - b.q) + (a.p - b.p) * (a.p - b.p)) / 2 AS cost, least(a.n, b.n) AS n
      FROM n a JOIN n b ON a.k = b.k AND a.g = 0 AND b.g <> 0),
s(k, g, r, mask, cost, n) AS (SELECT k, g, 0::BIGINT, 0::BIGINT, 0::DOUBLE, n FROM (SELECT DISTINCT k, g, n FROM c)
  UNION SELECT s.k, s.g, c.r, s.mask | (1::BIGINT << c.c), s.cost + c.cost, s.n FROM s JOIN c ON c.k = s.k AND c.g = s.g AND c.r = s.r + 1 WHERE s.mask & (1::BIGINT << c.c) = 0),
best AS (SELECT k AS l_orderkey, g, n AS n_matched, {pick}(cost) AS cost FROM s WHERE r = n GROUP BY k, g, n)
"""


def _totals(assigned):
    return assigned.where("partner IS NOT NULL").groupBy("l_orderkey", "g").agg(F.count("*").alias("n_matched"), (F.sum("cost") * 2).cast("long").alias("twice_cost"))


@query(_matched("min") + "SELECT l_orderkey, g, n_matched, CAST(cost * 2 AS BIGINT) AS twice_cost FROM best")
def multiple_linear_object_assignment_with_anchor(spark, sf_dir):
    return _totals(assignment.assign_to_anchor(_objects(spark, sf_dir), ["l_orderkey"], "g", F.col("g") == 0, "item", "v"))


@query(_matched("max") + "SELECT l_orderkey, g, n_matched, CAST(cost * 2 AS BIGINT) AS twice_cost FROM best")
def multiple_linear_array_assignment_with_anchor(spark, sf_dir):
    return _totals(assignment.assign_to_anchor(_objects(spark, sf_dir), ["l_orderkey"], "g", F.col("g") == 0, "item", "v", maximize=True))


@query(_matched("min") + """SELECT b.l_orderkey, a.n_anchors, CAST(sum(b.n_matched) AS BIGINT) AS n_partners, count(*) AS n_groups
FROM best b JOIN (SELECT l_orderkey, count(*) AS n_anchors FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY l_orderkey) a USING (l_orderkey) GROUP BY ALL""")
def multi_assign_dataframes(spark, sf_dir):
    # anchors of an order may be alike, so the place in the order tells them apart
    objects = _objects(spark, sf_dir).withColumn("item", F.concat_ws("|", "item", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")))
    found = assignment.aligned_groups(assignment.assign_to_anchor(objects, ["l_orderkey"], "g", F.col("g") == 0, "item", "v"), ["l_orderkey"], "g")
    partners = F.size(F.filter(F.map_values("partners"), lambda p: p.isNotNull()))
    return found.groupBy("l_orderkey").agg(F.count("*").alias("n_anchors"), F.sum(partners).cast("long").alias("n_partners"), F.max(F.size("partners")).cast("long").alias("n_groups"))


# disjoint sets: the line numbers of each order of a customer


def _members(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey")


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS c, o_orderkey AS o, bit_or(1 << l_linenumber) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r(c, last, m, chosen) AS (SELECT c, o, m, [o] FROM s UNION ALL SELECT r.c, s.o, r.m | s.m, list_append(r.chosen, s.o) FROM r JOIN s ON s.c = r.c AND s.o > r.last AND s.m & r.m = 0)
SELECT c AS o_custkey, CAST(bit_count(m) AS BIGINT) AS covered, array_to_string(chosen, ',') AS sets FROM r QUALIFY row_number() OVER (PARTITION BY c ORDER BY bit_count(m) DESC, chosen) = 1""")
def max_disjoint_set(spark, sf_dir):
    members = _members(spark, sf_dir)
    chosen = disjoint.max_disjoint_sets(members, ["o_custkey"], "o_orderkey", "l_linenumber").select("o_custkey", F.col("set").alias("o_orderkey"))
    sizes = members.distinct().groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"))
    joined = chosen.join(sizes, ["o_custkey", "o_orderkey"])
    return joined.groupBy("o_custkey").agg(F.sum("n").alias("covered"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("sets"))


@query()
def condense_sets_to_mds(spark, sf_dir):
    """Tests hold it against exhaustive search."""
    found = disjoint.condense_disjoint(_members(spark, sf_dir), ["o_custkey"], "o_orderkey", "l_linenumber")
    return found.select("o_custkey", "choice", F.col("set").alias("o_orderkey"))


# trees: a customer's orders and their lines, five steps deep

_LINES = """l AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS j FROM lineitem),
o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"""


def _customers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("l"))
    line = F.transform(F.coalesce("l", F.array()), lambda x: F.struct(x["l_partkey"].alias("part"), x["l_quantity"].cast("long").alias("quantity")))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), line.alias("lines")).alias("o"))
    return orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list("o")).alias("orders"))).alias("json"))


def _leaves(spark, sf_dir):
    return trees.leaf_paths(_customers(spark, sf_dir).withColumn("tree", trees.json_tree(F.col("json"))), ["o_custkey"], "tree")


@query(sql(_LINES, """SELECT o_custkey, printf('orders[%d].key', i) AS path, 3 AS depth, CAST(o_orderkey AS VARCHAR) AS json FROM o
UNION ALL SELECT o_custkey, printf('orders[%d].status', i), 3, '"' || o_orderstatus || '"' FROM o
UNION ALL SELECT o_custkey, printf('orders[%d].lines', i), 3, '[]' FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l)
UNION ALL SELECT o_custkey, printf('orders[%d].lines[%d].part', i, j), 5, CAST(l_partkey AS VARCHAR) FROM o JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT o_custkey, printf('orders[%d].lines[%d].quantity', i, j), 5, CAST(q AS VARCHAR) FROM o JOIN l ON l_orderkey = o_orderkey"""))
def nested_dict_walk(spark, sf_dir):
    return _leaves(spark, sf_dir).select("o_custkey", trees.path_text(F.col("path")).alias("path"), "depth", "json")


@query(sql(_LINES, """SELECT o_custkey, '{"audit":{"by":["nobody"]},"orders":[' || string_agg('{"key":' || o_orderkey || ',"lines":' || CASE WHEN i = 0 THEN '"hidden"' ELSE '[' || coalesce(x, '') || ']' END || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY i) || ']}' AS json
FROM o LEFT JOIN (SELECT l_orderkey, string_agg('{"part":' || l_partkey || ',"quantity":' || q || '}', ',' ORDER BY j) AS x FROM l GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_custkey"""))
def set_dict_value_by_graph(spark, sf_dir):
    """The first order's lines are replaced by a text, and a member is added three steps deep; then each tree is rebuilt."""
    values = F.array(*(F.struct(path.alias("path"), F.lit(json).alias("json")) for path, json in ((trees.path_of("orders", 0, "lines"), '"hidden"'), (trees.path_of("audit", "by", 0), '"nobody"'))))
    customers = _customers(spark, sf_dir).withColumn("tree", trees.json_tree(F.col("json")))
    return trees.from_leaves(customers, ["o_custkey"], "tree", lambda leaves: trees.json_of(trees.with_values(leaves, values)), "json")


def _xml(spark, sf_dir):
    """Each order as an element: attributes, a text, and its lines, which repeat."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("l"))
    line = F.transform("l", lambda x: F.concat(F.lit('<line part="'), x["l_partkey"], F.lit('"><box><size><q>'), x["l_quantity"].cast("long"), F.lit("</q></size></box></line>")))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", F.concat(F.lit('<order id="'), "o_orderkey", F.lit('" open="'), F.when(F.col("o_orderstatus") == "O", "true").otherwise("false"), F.lit('">'), F.array_join(line, ""), F.lit("<note>a &amp; b &lt;"), F.col("o_orderpriority"), F.lit("&gt;</note></order>")).alias("xml"))


_XML_LINES = _LINES + ", x AS (SELECT orders.o_orderkey, o_orderstatus, o_orderpriority, l_partkey, q, j, count(*) OVER (PARTITION BY orders.o_orderkey) AS n FROM orders JOIN l ON l_orderkey = orders.o_orderkey), p AS (SELECT *, CASE WHEN n > 1 THEN printf('line[%d]', j) ELSE 'line' END AS spot FROM x)"


@query(sql(_XML_LINES, """SELECT DISTINCT o_orderkey, '@id' AS path, CAST(o_orderkey AS VARCHAR) AS json FROM p UNION ALL SELECT DISTINCT o_orderkey, '@open', CASE o_orderstatus WHEN 'O' THEN 'true' ELSE 'false' END FROM p
UNION ALL SELECT DISTINCT o_orderkey, 'note', '"a & b <' || o_orderpriority || '>"' FROM p UNION ALL SELECT o_orderkey, spot || '.@part', CAST(l_partkey AS VARCHAR) FROM p UNION ALL SELECT o_orderkey, spot || '.box.size.q', CAST(q AS VARCHAR) FROM p"""))
def etree_to_simplified_dict(spark, sf_dir):
    leaves = trees.leaf_paths(_xml(spark, sf_dir).withColumn("tree", trees.xml_tree(F.col("xml"))), ["o_orderkey"], "tree")
    return leaves.select("o_orderkey", trees.path_text(F.col("path")).alias("path"), "json")


@query(sql(_XML_LINES, """SELECT o_orderkey, printf('<order id="%d" open="', o_orderkey) || any_value(CASE o_orderstatus WHEN 'O' THEN 'true' ELSE 'false' END) || '">'
  || string_agg(printf('<line part="%d"><box><size><q>%d</q></size></box></line>', l_partkey, q), '' ORDER BY j) || '<note>a &amp; b &lt;' || any_value(o_orderpriority) || '&gt;</note></order>' AS xml FROM p GROUP BY o_orderkey"""))
def dict_to_etree(spark, sf_dir):
    """Elements to trees to leaves, and back to the same text."""
    leaves = trees.leaf_paths(_xml(spark, sf_dir).withColumn("tree", trees.xml_tree(F.col("xml"), types=False)), ["o_orderkey"], "tree")
    return trees.xml_text(leaves, ["o_orderkey"], "order")


_NOISE = """SELECT event_id, '<' || event_type || '> "' || props || ' [' || event_id || ', {"p": ' || props || ', "q": ["]}", null]}] tail ] {' || user_id || '}' AS t FROM events"""


@query(f"""WITH t AS ({_NOISE}), a AS (SELECT event_id, t, unnest(range(1, length(t) + 1)) AS i FROM t), b AS (SELECT event_id, i FROM a WHERE substr(t, i, 1) IN ('{{', '[')), e AS (SELECT event_id, i AS j FROM a WHERE substr(t, i, 1) IN ('}}', ']'))
SELECT event_id, arg_max(s, (length(s), -i)) AS json FROM (SELECT event_id, b.i, substr(t, b.i, e.j - b.i + 1) AS s FROM t JOIN b USING (event_id) JOIN e USING (event_id) WHERE e.j > b.i) WHERE json_valid(s) GROUP BY event_id""")
def find_valid_json(spark, sf_dir):
    noise = F.concat(F.lit("<"), "event_type", F.lit('> "'), "props", F.lit(" ["), "event_id", F.lit(', {"p": '), "props", F.lit(', "q": ["]}", null]}] tail ] {'), "user_id", F.lit("}"))
    return trees.longest_json(table(spark, sf_dir, "events").select("event_id", noise.alias("t")), ["event_id"], "t")


# polygons: the lines of an order are the corners


def _polygons(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    corner = F.struct((F.col("l_partkey") % 23).cast("double").alias("x"), (F.col("l_quantity") / 2).alias("y"))
    corners = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", corner.alias("p")))).alias("c"))
    return corners.select("l_orderkey", F.transform("c", lambda x: x["p"]).alias("points"))


@query("""WITH c AS (SELECT l_orderkey, CAST(l_partkey % 23 AS DOUBLE) AS x, l_quantity / 2 AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)),
e AS (SELECT a.l_orderkey, CASE WHEN a.y <= b.y THEN a.x ELSE b.x END AS px, least(a.y, b.y) AS py, CASE WHEN a.y <= b.y THEN b.x ELSE a.x END AS qx, greatest(a.y, b.y) AS qy FROM c a JOIN c b ON b.l_orderkey = a.l_orderkey AND b.i = a.i % a.n + 1 WHERE a.n >= 3),
g AS (SELECT l_orderkey, r, c FROM (SELECT DISTINCT l_orderkey FROM e) CROSS JOIN (SELECT unnest(range(0, 24)) AS r) CROSS JOIN (SELECT unnest(range(0, 21)) AS c)),
h AS (SELECT g.l_orderkey, r, c FROM g JOIN e ON e.l_orderkey = g.l_orderkey AND py <= r AND r < qy AND px + (r - py) * (qx - px) / (qy - py) > c GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT l_orderkey, CAST(r AS BIGINT) AS "row", count(*) AS n_cells, CAST(min(c) AS BIGINT) AS first_col, CAST(max(c) AS BIGINT) AS last_col, CAST(sum(c * c) AS BIGINT) AS squares FROM h GROUP BY l_orderkey, r""")
def create_boolean_polygon_mask(spark, sf_dir):
    rows = polygons.scanline_rows(_polygons(spark, sf_dir), ["l_orderkey"], "points", (24, 21)).select("l_orderkey", "row", polygons.span_cells(F.col("spans")).alias("c"))
    squares = F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + c * c)
    return rows.select("l_orderkey", "row", F.size("c").cast("long").alias("n_cells"), F.element_at("c", 1).alias("first_col"), F.element_at("c", -1).alias("last_col"), squares.alias("squares"))


# draws

_U = "CAST('0x' || substr(md5('{}:' || {}), 1, 12) AS UBIGINT) / 281474976710656.0"


@query(f"""WITH l AS (SELECT l_orderkey, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)
SELECT l_orderkey, arg_min(l_partkey, s) AS l_partkey FROM l WHERE s > ({_U.format(7, "l_orderkey")}) * t GROUP BY l_orderkey""")
def np_axis_choice(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("l"))
    values, weights = F.transform("l", lambda x: x["l_partkey"]), F.transform("l", lambda x: x["l_quantity"])
    return lines.select("l_orderkey", draws.choose(values, weights, draws.uniform(["l_orderkey"], 7)).alias("l_partkey"))


@query(f"""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY -ln({_U.format(3, "o_orderkey")}) / o_totalprice, o_orderkey) AS r FROM orders WHERE o_totalprice > 0) WHERE r <= 50""")
def np_sample_along_first_axis(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return draws.sample_without_replacement(orders, ["o_orderkey"], "o_totalprice", 50, ["o_orderpriority"], seed=3).select("o_orderkey", "o_orderpriority")


# segments: up to 400 frames from each event on


@query(sql(E, """SELECT s.event_id, CAST(trunc(min(t.x)) AS BIGINT) AS x, CAST(trunc(min(t.y)) AS BIGINT) AS y, CAST(trunc(max(t.x)) AS BIGINT) AS x_max, CAST(trunc(max(t.y)) AS BIGINT) AS y_max, count(t.x) AS n_frames
FROM (SELECT event_id, user_id, frame_index AS a, frame_index + event_id * 7 % 400 AS b FROM e) s LEFT JOIN (SELECT * FROM e WHERE sparse IS NOT NULL) t ON t.user_id = s.user_id AND t.frame_index BETWEEN s.a AND s.b GROUP BY s.event_id"""))
def get_bbox_from_event_segment(spark, sf_dir):
    frames = events(spark, sf_dir)
    spans = frames.select("event_id", *IDS, F.col("frame_index").alias("a"), (F.col("frame_index") + F.col("event_id") * 7 % 400).alias("b"))
    known = F.col("sparse").isNotNull()
    trace = frames.select(*IDS, "frame_index", F.when(known, F.col("x")).alias("x"), "y", F.col("x").alias("x_max"), F.col("y").alias("y_max"))
    found = segments.segment_extremes(spans, trace, IDS, "a", "b", ["x", "y"], ["x_max", "y_max"])
    return found.select("event_id", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "x_max", "y_max")), "n_frames")


@query()
def create_similarity_dendrogram(spark, sf_dir):
    """The merge table of the centroids of the labels; tests hold it against a brute-force agglomeration."""
    centroids = vectors.vector_medians(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    distances = vectors.pairwise_distances(centroids, centroids, "label", "centroid", ordered_pairs=True)
    return linkage.complete_linkage(distances, "key_a", "key_b")


# written and read back

#: Tasks that write many small files.
FILE_TASKS = 200


def _scratch(spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(sql(E + ", n AS (SELECT user_id, count(DISTINCT event_type) AS n FROM e GROUP BY user_id)", """SELECT CAST(user_id AS VARCHAR) || CASE WHEN n > 1 THEN '_' || event_type ELSE '' END AS recording, frame_index, value, y FROM e JOIN n USING (user_id)"""))
def get_sleap_tracking_df(spark, sf_dir):
    """A folder of delimited files, one or more for each user, with a track for each kind of event."""
    root = _scratch(spark, "tracks")
    rows = events(spark, sf_dir).select("user_id", F.col("event_type").alias("track"), F.col("frame_index").alias("frame_idx"), F.col("value").alias("body.score"), F.col("y").alias("body.y"))
    # many small files: dealt by count, as parts joined by their size leave most cores idle
    files.write_recordings(rows, root, "user_id", max(FILE_TASKS, spark.sparkContext.defaultParallelism))
    return files.track_folder(spark, root, recording=r"user_id=(\d+)").select("recording", "frame_index", F.col("`body.score`").alias("value"), F.col("`body.y`").alias("y"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def write_sqlite_table(spark, sf_dir):
    """Replaced once, appended to once, and read back."""
    path = urlparse(_scratch(spark, "orders")).path + ".db"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sqlite.write_sqlite_table(orders, path, "orders")
    sqlite.write_sqlite_table(orders.where("o_orderstatus = 'F'"), path, "orders", "append")
    return sqlite.read_sqlite_table(spark, path, "orders")


@query("SELECT DISTINCT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def build_file_df(spark, sf_dir):
    """A folder of files in two levels, found again by their names."""
    root = _scratch(spark, "customers")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").write.partitionBy("c_mktsegment", "c_nationkey").csv(root)
    found = files.file_table(spark, root, r"^c_mktsegment=([^/]+)/c_nationkey=(\d+)/part-[^/]+$", ["segment", "nation"])
    return found.select("segment", "nation").distinct()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def read_sqlite_table(spark, sf_dir):
    path = urlparse(_scratch(spark, "all-orders")).path + ".db"
    sqlite.write_sqlite_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, "orders")
    return sqlite.read_sqlite_table(spark, path, "orders")
