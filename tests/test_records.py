"""Maps compared, graphs of pairs, skeleton checks, sampled bouts, flat columns: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from ethoframe.functions import arrays, columns
from ethoframe.operators import bouts, networks, records, tracks


def test_key_agreement(spark):
    rows = [(None, 1, {"a": 1, "b": None, "c": 5}), (None, 2, {"a": 1, "b": None, "d": 7}), (2, 3, {"a": 1}), (2, 4, {"a": None}), (3, 5, {"x": 1}), (3, 6, None), (3, 7, {}), (4, 8, {})]
    df = spark.createDataFrame(rows, "g int, r int, m map<string, int>")
    got = {(r.g, r.key): (r.n_holding, r.shared, r.common, r.variable, r.owner) for r in records.key_agreement(df, ["g"], "r", "m").collect()}
    assert got == {
        (None, "a"): (2, True, True, False, None), (None, "b"): (2, True, True, False, None), (None, "c"): (1, False, False, False, 1), (None, "d"): (1, False, False, False, 2),
        (2, "a"): (2, True, False, True, None), (3, "x"): (1, False, False, False, 5),
    }
    values = {(r.g, r.key): r["values"] for r in records.values_by_key(df, ["g"], "r", "m").collect()}
    assert values[None, "a"] == [1, 1] and values[2, "a"] == [1, None] and values[None, "c"] == [5] and (4, "x") not in values
    assert records.key_agreement(df.limit(0), ["g"], "r", "m").count() == 0


def test_graph(spark):
    pairs = spark.createDataFrame([("b", "a", 1, 1), ("a", "b", 2, 2), ("a", "a", 3, 3), (None, "a", 4, 4), ("c", "b", 5, 5)], "p string, q string, w int, t int")
    edges = networks.graph_edges(pairs, ("p", "q"), ["w"], ["t"])
    assert sorted(map(tuple, edges.collect())) == [("a", "a", 3), ("a", "b", 2), ("b", "c", 5)]
    assert sorted(map(tuple, networks.graph_nodes(edges, "w").collect())) == [("a", 3, 2, 1, 5), ("b", 2, 1, 1, 7), ("c", 1, 0, 1, 5)]
    directed = networks.graph_edges(pairs, ("p", "q"), ["w"], ["t"], directed=True)
    assert sorted(map(tuple, directed.collect())) == [("a", "a", 3), ("a", "b", 2), ("b", "a", 1), ("c", "b", 5)]


def test_skeleton_validity(spark):
    edges = spark.createDataFrame([(1, 0, "a", "b"), (1, 0, "b", "b"), (1, None, "a", "z"), (2, 0, "a", None)], "id int, edge_index int, node_0 string, node_1 string")
    points = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, keypoint_name string")
    got = {r.id: (r.edges, r.null_indices, r.repeated_indices, r.loops, r.unknown_ends) for r in tracks.skeleton_validity(edges, points, ["id"]).collect()}
    assert got == {1: (3, 1, 1, 1, 1), 2: (1, 0, 0, 0, 1)}


def test_sampled_bouts_and_constant_arrays(spark):
    rows = spark.createDataFrame([(1, 5, 4, "walk"), (1, 5, 5, "walk"), (1, 5, 5, "rest")], "id int, onset int, frame int, behavior string")
    assert sorted(map(tuple, bouts.sampled_bouts(rows, ["id"], "behavior", "onset").collect())) == [(1, 5, None, None, "rest"), (1, 5, None, None, "walk")]
    items = spark.createDataFrame([([1, 1, 1],), ([1, 2],), ([None, None],), ([None, 1],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in items.select(arrays.collapse_constant(F.col("a"))).collect()] == [[1], [1, 2], [None], [None, 1], [], None]


def test_flat_names(spark):
    df = spark.sql("SELECT 1 AS k, 2 AS l, named_struct('x', 1, 'y', named_struct('z', CAST(NULL AS INT), 'a.b', 3)) AS s")
    assert columns.flatten_columns(df).columns == ["k", "l", "s/x", "s/y/z", "s/y/a.b"]
    flat = columns.flatten_keys(df, ["k", "l"])
    assert flat.columns == ["key", "s/x", "s/y/z", "s/y/a.b"] and tuple(flat.first()) == ((1, 2), 1, None, 3)
