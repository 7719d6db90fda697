"""Steps that were mended for large tables, against plain Python and against bounds of the rows they shuffle."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoframe import graph
from ethoframe.functions import geometry, raster, trees
from ethoframe.llm import vectors as embeddings
from ethoframe.operators import polygons, tracks, vectors
from ethoframe.plans import registry
from ethoframe.sources import files


def shuffled(spark, run) -> int:
    """Records that the stages of run write to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    total = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    wait()
    before = total()
    run()
    wait()
    return total() - before


def closed(cells, grow, shrink):
    near = lambda r, c, k: [(r if r is None else r + i, c if c is None else c + j) for i in range(-k, k + 1) for j in range(-k, k + 1)]
    grown = {p for c in cells for p in near(*c, grow)}
    return {p for p in {p for c in grown for p in near(*c, shrink)} if grown.issuperset(near(*p, shrink))}


@pytest.mark.parametrize(("dilation", "erosion"), [(3, 3), (5, 3), (3, 7), (1, 3), (3, 1), (17, 19)])
def test_clean_across_tiles(spark, dilation, erosion):
    rng = random.Random(dilation * 100 + erosion)
    masks = {k: {(rng.randint(-40, 40), rng.randint(-20, 60)) for _ in range(n)} for k, n in (("a", 900), ("b", 3), ("c", 2500))} | {None: {(15, 15), (16, 16), (10**10, -(10**10))}}
    rows = [(k, *c) for k, cells in masks.items() for c in cells for _ in range(2)]
    df = spark.createDataFrame(rows, "k string, row long, col long")
    got = [tuple(r) for r in raster.clean(df, ["k"], dilation, erosion).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, *c) for k, cells in masks.items() for c in closed(cells, dilation // 2, erosion // 2)}


def test_clean_keeps_null_coordinates(spark):
    cells = {(None, 3), (None, 5), (2, None), (None, None), (1, 1)}
    got = raster.clean(spark.createDataFrame(list(cells), "row int, col int"), []).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, closed(cells, 1, 1)))


def test_clean_shuffles_lines_not_cells(spark):
    cells = spark.range(0, 4000, 1, 1).selectExpr("id DIV 40 AS k", "id % 40 DIV 8 AS row", "id % 8 AS col")
    assert shuffled(spark, raster.clean(cells, ["k"]).collect) < 4000  # nine times as many cells before


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
        return None
    return 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def odd_vectors(sizes):
    """Rows (key, vector, group): copies, keys in several groups, vectors without a length, groups of one, null groups."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice(sizes))], rng.choice("abc")) for i in range(40)]
    return [*rows, (3, rows[0][1], "a"), (3, rows[1][1], "b"), (50, rows[0][1], "a"), (51, [0.0] * 4, "a"), (52, None, "b"), (53, [1.0, None, 2.0, 0.0], "c"), (54, [1.0, 2.0, 3.0, 4.0], "alone"), (55, [1.0, 2.0, 0.0, 4.0], None)]


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


def test_silhouettes_of_odd_rows(spark):
    rows = odd_vectors((4,))
    want = {}
    for key, g in {(k, g) for k, _, g in rows}:
        mean = {}
        for other in {g for _, _, g in rows}:
            d = [cosine(a, b) for k, a, own in rows if (k, own) == (key, g) for j, b, og in rows if og == other and j != key]
            mean[other] = statistics.fmean(x for x in d if x is not None) if any(x is not None for x in d) else None
        a = mean[g] if g is not None else None
        b = min((m for o, m in mean.items() if m is not None and None not in (o, g) and o != g), default=None)
        want[key, g] = 0.0 if a is None else None if b is None else (b - a) / max(a, b)
    df = spark.createDataFrame(rows, "k int, v array<double>, g string")
    got = {(r.k, r.g): r.silhouette for r in vectors.silhouettes(df, "k", "v", "g").collect()}
    assert set(got) == set(want) and all(near(got[k], want[k]) for k in want), [(k, got[k], want[k]) for k in want if not near(got[k], want[k])]
    assert vectors.silhouettes(df.where("k = 1"), "k", "v", "g").count() == 0


def test_silhouettes_do_not_pair_rows(spark):
    df = spark.range(3000).selectExpr("id k", "array(sin(id), cos(id)) v", "id % 3 g")
    plan = vectors.silhouettes(df, "k", "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "key_b" not in plan


@pytest.mark.parametrize(("sizes", "block", "cells"), [((4,), 4096, 4_000_000), ((4, 3), 7, 20)])
def test_distances_to_groups(spark, sizes, block, cells):
    rows = odd_vectors(sizes)
    df = spark.createDataFrame(rows, "k int, v array<double>, g string")
    got = {(r.key_a, r.g): r.distance for r in vectors.distances_to_groups(df, "k", "v", "g", block, cells).collect()}
    want = {}
    for key, other in {(k, g) for k, _, _ in rows for _, _, g in rows}:
        d = [x for k, a, _ in rows if k == key for _, b, g in rows if g == other if (x := cosine(a, b)) is not None]
        want[key, other] = statistics.median(d) if d else None
    assert set(got) == set(want) and all(near(got[k], want[k]) for k in want)


@pytest.mark.parametrize(("depth", "stored"), [(5, 1), (9, 2)])
def test_trees_are_walked_six_levels_at_a_time(spark, monkeypatch, depth, stored):
    calls, real = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df, label: calls.append(label) or real(df, label))
    text = '{"a":' * depth + "[]" + "}" * depth
    df = spark.createDataFrame([(1, text), (2, "3"), (3, "null"), (4, "{}"), (5, None)], "k int, t string").withColumn("tree", trees.json_tree(F.col("t")))
    got = {(r.k, r.depth, r.json) for r in trees.leaf_paths(df, ["k"], "tree").collect()}
    assert got == {(1, depth, "[]"), (2, 0, "3"), (3, 0, "null"), (4, 0, "{}")} and len(calls) == stored


def test_medians_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = spark.range(60).select((F.col("id") % 3).alias("label"), F.lit(0).alias("step"), F.lit("a").alias("keypoint_name"), counted("id").alias("x"), F.lit(1.0).alias("y"))
    got = {(r.label, r.x, r.n) for r in tracks.trajectory_medians(rows, "label", "step").collect()}
    assert got == {(0, 28.5, 20), (1, 29.5, 20), (2, 30.5, 20)} and seen.value == 60


def test_polygons_are_cut_where_they_lie(spark, monkeypatch):
    square = "transform(array(array(0.5, 0.5), array(9.5, 0.5), array(9.5, 9.5), array(0.5, 9.5)), p -> named_struct('x', p[0] + id % 3, 'y', p[1]))"
    df = spark.range(0, 2000, 1, 2).selectExpr("id", f"{square} AS points")
    want = {(i, r, 1 + i % 3, 9 + i % 3) for i in range(2000) for r in range(1, 10)}
    for most in (polygons.CROSSINGS, 7):
        monkeypatch.setattr(polygons, "CROSSINGS", most)
        out = []
        assert shuffled(spark, lambda out=out: out.extend(tuple(r) for r in polygons.scanline_intervals(df, ["id"], "points", (16, 20)).collect())) == 0  # one row a polygon and raster row before
        assert len(out) == len(want) and set(out) == want


def merged_one_by_one(boxes):
    left = set(boxes)
    while True:
        met = next(((a, b) for a in left for b in left if a < b and a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]), None)
        if met is None:
            return left
        (ax, ay, aw, ah), (bx, by, bw, bh) = met
        x, y = min(ax, bx), min(ay, by)
        left = left - set(met) | {(x, y, max(ax + aw, bx + bw) - x, max(ay + ah, by + bh) - y)}


@pytest.mark.parametrize(("group", "pairs"), [(512, 2_000_000), (10, 30)])
def test_boxes_are_dealt_once(spark, monkeypatch, group, pairs):
    rng = random.Random(8)
    monkeypatch.setattr(geometry, "GROUP", group), monkeypatch.setattr(geometry, "PAIRS", pairs)
    rows = [(k if k else None, *(float(rng.randrange(n)) for n in (60, 60)), *(float(rng.randint(1, 9)) for _ in "wh")) for k in range(300) for _ in range(rng.choice((1, 3, 12)))]
    rows += [(1000, 3.0 * i, 0.0, 4.0, 1.0) for i in range(8)] + rows[:40]  # a chain, copies
    df = spark.createDataFrame(rows, "k int, x double, y double, w double, h double").selectExpr("k", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS box")
    out, by = [], {}
    for k, *box in rows:
        by.setdefault(k, set()).add(tuple(box))
    sent = shuffled(spark, lambda: out.extend((r.k, *r.box) for r in geometry.merge_boxes(df, ["k"]).collect()))
    want = {(k, *b) for k, boxes in by.items() for b in merged_one_by_one(boxes)}
    assert len(out) == len(want) and set(out) == want
    assert group == 10 or sent <= len(rows) + 50  # several times in every round before


def test_track_files_are_opened_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 40, "ab"[i % 7 % 2], float(i)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "timestamp(ts) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    stored, real = [], files.materialize
    monkeypatch.setattr(files, "materialize", lambda df, label: stored.append(df) or real(df, label))
    got = registry.queries()["get_sleap_tracking_df"](spark, str(tmp_path))
    assert got.count() == 400 and len(stored) == 1
    assert "Scan text" not in got._jdf.queryExecution().executedPlan().toString()  # three scans of all files before
    assert len(stored[0].select("file_path").distinct().collect()) == 40
    assert len({p.split("part-")[1].split("-")[0] for (p,) in stored[0].select("file_path").distinct().collect()}) > 8  # parts joined by size wrote them all before


@pytest.mark.parametrize(("hot", "small"), [(200_000, 500_000), (3, 0)])
def test_components_with_hot_ids(spark, monkeypatch, hot, small):
    monkeypatch.setattr(graph, "HOT", hot), monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(12)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1000 + rng.randrange(60)) for i in range(60)]
    order = rng.sample(range(2000, 2100), 100)
    links += list(zip(order, order[1:])) + [(3000, i) for i in range(2900, 2960)] + [(3100, 3100 + i) for i in range(1, 60)] + [(5, None), (7, 7), (None, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = [tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(got) == len(root) and dict(got) == {x: find(x) for x in root}


def test_settled_links_are_not_looked_up(spark):
    star = spark.range(1, 3001, 1, 2).selectExpr("id AS a", "0L AS b")
    assert shuffled(spark, lambda: graph.components(star).count()) < 3 * 3000 + 100  # over 15 times before


@pytest.mark.parametrize(("tile", "join"), [(32 << 20, 1 << 18), (40_000, 30)])
def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch, tile, join):
    for name, value in (("BLOCK_ROWS", 25), ("LEAF_ROWS", 8), ("TILE_BYTES", tile), ("JOIN_ROWS", join)):
        monkeypatch.setattr(embeddings, name, value, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[700:1100] = x[rng.integers(0, 700, 400)] + rng.normal(size=(400, 16)) * 0.02  # near copies
    x[1100:1200] = x[5]  # one large group, over several blocks
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    while (new := np.minimum(root, np.where(linked, root, len(u)).min(axis=1))).tolist() != root.tolist():
        root = new
    got, df = {}, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent = shuffled(spark, lambda: got.update({r.vec_id: (r.n, r.root) for r in embeddings.link_counts(df).groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("root").alias("root")).collect()}))
    assert {i: n for i, (n, _) in got.items()} == {i: int(n) for i, n in enumerate(linked.sum(axis=1)) if n}
    assert tile < 1 << 20 or sent < 3 * len(u)  # two records of each pair of blocks before
    classes = {r.vec_id: r.component_id for r in embeddings.near_duplicates(df).collect()}
    assert classes == dict(enumerate(root.tolist()))


def test_values_are_set_inside_of_rows(spark, monkeypatch):
    stored, real = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df, label: stored.append(label) or real(df, label))
    sf_dir = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    sent = shuffled(spark, lambda: registry.queries()["set_dict_value_by_graph"](spark, sf_dir).count())
    assert sent < 2 * lines and len(stored) == 1  # leaves were shuffled several times before, and stored for every level


@pytest.mark.parametrize("depth", [3, 8, 40])
def test_deep_trees_keep_their_text(spark, depth):
    text = '{"a":' * depth + '[1,{"b":null}]' + "}" * depth
    df = spark.createDataFrame([(1, text), (2, '{"a":2}'), (3, None)], "k int, t string").withColumn("tree", trees.json_tree(F.col("t")))
    new = F.array(F.struct(trees.path_of(*["a"] * depth, "x").alias("path"), F.lit("7").alias("json")))
    got = {r.k: r.json for r in trees.from_leaves(df, ["k"], "tree", lambda leaves: trees.json_of(trees.with_values(leaves, new)), "json").collect()}
    assert got[1] == '{"a":' * depth + '[1,{"b":null},7]' + "}" * depth  # an element comes to an array that gets a member, as in tree_text()
    assert got[2] == '{"a":' * depth + '{"x":7}' + "}" * depth and set(got) == {1, 2}


def test_track_files_lie_side_by_side(spark, tmp_path):
    rows = [(7, "a", 1, 0.5, None), (7, 'b,"', 2, None, 1.0), (12, "a", 1, 1e-7, 2.0)]
    df = spark.createDataFrame(rows, "user_id long, track string, frame_idx long, `body.score` double, `body.y` double")
    files.write_recordings(df, f"{tmp_path}/x.y/.z", "user_id", 16)
    made = sorted(p.name.split(",")[0] for p in (tmp_path / "x.y" / ".z").iterdir() if p.suffix == ".csv" and not p.name.startswith("."))
    assert made == ["user_id=12", "user_id=7"]  # a folder for each before, which a task had to list
    back = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/x.y/.z")
    assert sorted((r.track, r.frame_idx, r["body.score"], r["body.y"]) for r in back.collect()) == [("a", "1", "0.5", None), ("a", "1", "1.0E-7", "2.0"), ('b,"', "2", None, "1.0")]
