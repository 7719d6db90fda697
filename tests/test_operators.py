"""Golden cases and properties of operators that SQL expresses badly or not at all."""

import itertools
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from ethoframe.frames import nan_to_null
from ethoframe.functions import angles, arrays, columns, geometry, raster, text
from ethoframe.operators import align, bouts, runs, selection, smoothing, tracks, vectors
from ethoframe.sources import files
from ethoframe.sources.cache import cached
from ethoframe.sources.sqlite import read_sqlite_table, sqlite_tables


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_runs_ignore_gaps_unless_asked(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (5, "b"), (9, "b"), (10, None), (11, None)], "frame_index long, v string")
    got = sorted(tuple(r) for r in runs.run_length_encode(df, "v").collect())
    assert got == [(1, 2, 2, "a"), (5, 9, 5, "b"), (10, 11, 2, None)]
    assert runs.run_length_encode(df, "v", break_on_gap=True).count() == 4
    assert runs.run_length_encode(df, "v", drop_values=[None, "b"]).count() == 1


def test_runs_and_expansion_are_inverse(spark):
    rng = random.Random(1)
    rows = [(i, f, rng.choice(["x", "y", None])) for i in range(5) for f in range(40)]
    df = spark.createDataFrame(rows, "id long, frame_index long, v string")
    back = runs.expand_runs(runs.run_length_encode(df, "v", ["id"]), "frame_index", "v")
    assert sorted(map(tuple, back.select("id", "frame_index", "v").collect()), key=str) == sorted(rows, key=str)


def test_intervals_that_end_early_give_nothing(spark):
    df = spark.createDataFrame([(3, 1), (2, 2), (1, 3)], "s long, e long")
    assert sorted(r["index"] for r in runs.expand_limits(df, "s", "e").collect()) == [1, 2, 2, 3]
    assert sorted(r["index"] for r in runs.expand_limits(df, "s", "e", inclusive=False).collect()) == [1, 2]


def test_merged_chunks_follow_the_mean(spark):
    values = [1.0, 1.5, 2.2, 9.0, 8.5, 1.0]
    df = spark.createDataFrame([(2 * i, 2 * i + 1, v) for i, v in enumerate(values)], "start_index long, end_index long, run_value double")
    want, acc = [], []
    for i, v in enumerate(values):
        if acc and abs(v - sum(acc[-1][2]) / len(acc[-1][2])) <= 1.0:
            acc[-1] = (acc[-1][0], 2 * i + 1, [*acc[-1][2], v])
        else:
            acc.append((2 * i, 2 * i + 1, [v]))
    want = [(a, b, pytest.approx(sum(v) / len(v)), len(v)) for a, b, v in acc]
    assert sorted(map(tuple, runs.merge_chunks(df, [], 1.0).collect())) == want


def test_bouts_and_booleans_are_inverse(spark):
    df = spark.createDataFrame([(f, f in (1, 2, 5), f in (2, 3)) for f in range(7)], "frame_index long, a boolean, b boolean").withColumn("id", F.lit(1))
    found = bouts.boolean_bouts(df, ["a", "b"], ["id"])
    back = bouts.bouts_to_behaviour(found, ["a", "b"], ["id"])
    assert {tuple(r)[1:] for r in back.collect()} == {(1, True, False), (2, True, True), (3, False, True), (4, False, False), (5, True, False)}
    with pytest.raises(Exception, match="more than one label"):
        bouts.single_label(df, ["a", "b"]).collect()


def test_interpolation_golden(spark):
    values = [None, 1.0, None, 3.0, None, None, 9.0, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "id long, frame_index long, v double")
    get = lambda **k: [r.v for r in smoothing.interpolate(df, "v", ["id"], **k).orderBy("frame_index").collect()]
    assert get(limit=1) == [None, 1.0, 2.0, 3.0, None, None, 9.0, None]
    assert get() == [None, 1.0, 2.0, 3.0, 5.0, 7.0, 9.0, None]
    fixed = smoothing.fix_timestamps(df.na.fill(0.0), "v", ["id"], "frame_index", name="m").orderBy("frame_index").collect()
    assert [r.m for r in fixed] == [0.0, 1.0, 2.0, 3.0, 5.0, 7.0, 9.0, 11.0]


def test_angles(spark):
    a = lambda x: angles.normalize_angle(F.lit(float(x)))
    assert tuple(one(spark, a(180).alias("a"), a(-180).alias("b"), a(0).alias("c"), a(190).alias("d"), a(-190).alias("e"))) == (-180, -180, 0, -170, 170)
    m = [[2, 1, 3], [-1, 4, 5]]
    p = angles.affine(F.lit(2.0), F.lit(7.0), m)
    q = angles.affine(p["x"], p["y"], angles.inverted_affine(m))
    assert tuple(one(spark, q["x"].alias("x"), q["y"].alias("y"))) == pytest.approx((2, 7))
    with pytest.raises(Exception, match="no zero"):
        one(spark, angles.linear_zero(F.lit(0.0), F.lit(1.0)).alias("z"))


def test_circular_median_by_hand(spark):
    rng = random.Random(2)
    theta = [rng.uniform(-math.pi, math.pi) for _ in range(20)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(theta)], "id long, frame_index long, t double")
    got = [r.s for r in smoothing.smooth_angle(df, "t", ["id"], size=5, name="s").orderBy("frame_index").collect()]
    mid = lambda v: sorted(v)[len(v) // 2] if len(v) % 2 else sum(sorted(v)[len(v) // 2 - 1 : len(v) // 2 + 1]) / 2
    for i, g in enumerate(got):
        w = theta[max(0, i - 2) : i + 3]
        assert g == pytest.approx(math.atan2(mid([math.sin(x) for x in w]), mid([math.cos(x) for x in w])))


def test_dominant_frequency(spark):
    df = spark.createDataFrame([(1, i, 5 + math.sin(2 * math.pi * 3 * i / 30)) for i in range(300)], "id long, frame_index long, v double")
    assert smoothing.dominant_frequency(df, "v", ["id"], rate=30).first().frequency == pytest.approx(3.0)


def test_geometry(spark):
    box = lambda *v: geometry.box(*(F.lit(float(x)) for x in v))
    r = one(
        spark, geometry.boxes_overlap(box(0, 0, 2, 2), box(2, 0, 1, 1)).alias("touch"), geometry.box_intersection(box(0, 0, 3, 3), box(1, 1, 5, 5)).alias("i"),
        geometry.in_box(F.lit(2.0), F.lit(2.0), box(0, 0, 2, 2)).alias("edge"), geometry.polygon_centroid(geometry.box_polygon(box(0, 0, 4, 2))).alias("c"),
        geometry.polygon_area(geometry.box_polygon(box(0, 0, 4, 2))).alias("area"), geometry.in_polygon(F.lit(1.0), F.lit(1.0), geometry.box_polygon(box(0, 0, 4, 2))).alias("inside"),
        geometry.polygon_distance(F.lit(7.0), F.lit(1.0), geometry.box_polygon(box(0, 0, 4, 2))).alias("away"), geometry.scale_box(box(0, 0, 2, 2), 2, 1, 0, 1).alias("s"),
    )
    assert not r.touch and tuple(r.i) == (1, 1, 2, 2) and r.edge and tuple(r.c) == (2, 1) and r.area == 8 and r.inside and r.away == 3 and tuple(r.s) == (-1, -1, 4, 4)


def test_merged_boxes(spark):
    rows = [(1, (0.0, 0.0, 2.0, 2.0)), (1, (1.0, 1.0, 2.0, 2.0)), (1, (2.5, 2.5, 2.0, 2.0)), (1, (9.0, 9.0, 1.0, 1.0)), (2, (0.0, 0.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows, "id long, box struct<x: double, y: double, w: double, h: double>")
    got = {(r.id, tuple(r.box)) for r in geometry.merge_boxes(df, ["id"]).collect()}
    assert got == {(1, (0, 0, 4.5, 4.5)), (1, (9, 9, 1, 1)), (2, (0, 0, 1, 1))}


def test_areas(spark):
    areas = spark.createDataFrame([("a", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), ("b", [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], "name string, polygon array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 2.9)], "id long, x double, y double")
    both = {r.id: r.area for r in geometry.label_points(points, areas, 2, mode="all").collect()}
    assert both == {1: ["a"], 2: ["a", "b"], 3: []}
    assert {r.id: r.area for r in geometry.label_points(points, areas, 2, outside="closest").collect()} == {1: "a", 2: "a", 3: "b"}
    with pytest.raises(Exception, match="no area"):
        geometry.label_points(points, areas, 2, outside="raise").collect()


def test_assignment_is_optimal(spark):
    rng = random.Random(4)
    cost = {(p, r, c): round(rng.uniform(0, 9), 3) for p in range(6) for r in range(2 + p % 4) for c in range(4)}
    df = spark.createDataFrame([(*k, v) for k, v in cost.items()], "p long, r long, c long, cost double")
    for maximize in (False, True):
        total = {r.p: r.t for r in vectors.assign(df, ["p"], "r", "c", "cost", maximize).groupBy("p").agg(F.sum("cost").alias("t")).collect()}
        for p in range(6):
            n = 2 + p % 4
            sums = [sum(cost[p, r, c] for r, c in enumerate(cols)) for cols in itertools.permutations(range(4), min(n, 4))] if n <= 4 else [sum(cost[p, r, c] for c, r in enumerate(rows)) for rows in itertools.permutations(range(n), 4)]
            assert total[p] == pytest.approx(max(sums) if maximize else min(sums))


def test_as_of_directions(spark):
    df = spark.createDataFrame([(1, f) for f in (1, 4, 5, 10)], "id long, frame_index long")
    known = spark.createDataFrame([(1, 4), (1, 7)], "id long, frame_index long")
    get = lambda d: {r.frame_index: r.known_index for r in align.as_of(df, known, ["id"], direction=d).collect()}
    assert get("backward") == {1: None, 4: 4, 5: 4, 10: 7} and get("forward") == {1: 4, 4: 4, 5: 7, 10: None} and get("closest") == {1: 4, 4: 4, 5: 4, 10: 7}


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(3, 1.0), (None, 2.0)], "k long, w double")
    left, right = align.reindex_to_union([a, b], ["k"], {"w": 0.0})
    assert {(r.k, r.v, r.w) for r in left.collect()} == {(1, "x", 0.0), (3, "y", 0.0), (None, None, 0.0)}
    assert {(r.k, r.w) for r in right.collect()} == {(1, 0.0), (3, 1.0), (None, 2.0)}
    assert sorted(r.k for r in align.missing_ints(spark.createDataFrame([(1,), (4,), (250_000,), (250_002,)], "k long"), "k").collect())[:3] == [2, 3, 5]
    with pytest.raises(Exception, match="not in the reference"):
        align.positions_in(a, "v", ["x"]).collect()


def test_splits(spark):
    df = spark.range(1001).withColumn("g", F.col("id") % 3)
    sizes = [r["count"] for r in selection.split_parts(df, ["id"], 4, by=["g"]).groupBy("g", "part").count().collect()]
    assert sum(sizes) == 1001 and max(sizes) - min(sizes) <= 1
    shared = selection.split_sharing(df, ["id"], 3, share=0.3, share_count=2)
    assert shared.count() == pytest.approx(1001 * 1.3, rel=0.05) and shared.select("id").distinct().count() == 1001
    overlap = {(r.sample_a, r.sample_b): r.n for r in selection.split_overlaps(shared, ["id"]).collect()}
    assert all(overlap[p] == pytest.approx(100, rel=0.5) for p in ((0, 1), (0, 2), (1, 2)))
    assert sorted(map(tuple, selection.split_parts(df, ["id"], 4).collect())) == sorted(map(tuple, selection.split_parts(df.repartition(7), ["id"], 4).collect()))


def test_joined_sets(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "d"), (5, "c"), (5, "d")], "s long, m string")
    assert {r.m: r.group for r in selection.joined_sets(members, "s", "m").collect()} == {"a": 1, "b": 1, "c": 3, "d": 3}


def united(rows):
    """{member: group} by union-find."""
    root, at = {}, {}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for s, m in rows:
        root.setdefault(s, s)
        a, b = find(s), find(at.setdefault(m, s))
        root[max(a, b)] = min(a, b)
    return {m: find(s) for m, s in at.items()}


def test_joined_sets_against_union_find(spark):
    import random

    rng = random.Random(4)
    order = rng.sample(range(1000, 2000), 150)
    rows = [(s, f"chain{i + k}") for i, s in enumerate(order) for k in (0, 1)]  # a long chain
    rows += [(rng.randrange(900), f"m{rng.randrange(700)}") for _ in range(800)] + [(3000, "alone"), (3000, "alone")]
    got = selection.joined_sets(spark.createDataFrame(rows, "s long, m string"), "s", "m").collect()
    assert {r.m: r.group for r in got} == united(rows) and len(got) == len({m for _, m in rows})
    assert len(set(united(rows).values())) > 20


def test_unified_sets_takes_all_of_lineitem(spark, tmp_path):
    from ethoframe.plans import registry

    rows = [(10 * i + k, 5 * i + j, float(1 + (i + j) % 50)) for i in range(40) for k in range(3) for j in (k, k + 1)] + [(9, 0, 1.0), (5, 21, 50.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["unified_sets"](spark, str(tmp_path)).collect()
    assert {r.l_partkey: r.group for r in got} == united([r[:2] for r in rows]) and len(got) == len({r[1] for r in rows})


def test_tracks(spark):
    rows = [(1, f, k, float(x), float(y)) for f in range(3) for k, x, y in (("nose", 2 + f, 1), ("tail", 0 + f, 1), ("mid", 1 + f, 1))]
    track = spark.createDataFrame(rows, "id long, frame_index long, keypoint_name string, x double, y double")
    norm = tracks.norm_frames(track, ["id"], "nose")
    out = {(r.frame_index, r.keypoint_name): (r.x, r.y) for r in tracks.normalise(track, norm, ["id", "frame_index"]).collect()}
    assert all(out[f, "nose"] == pytest.approx((1, 0)) and out[f, "tail"] == pytest.approx((-1, 0)) for f in range(3))
    medians = tracks.trajectory_medians(track.withColumn("label", F.lit("a")), "label", "frame_index")
    assert tracks.complete_medians(medians, "label", "frame_index").first().complete
    assert len(tracks.trajectory_vectors(medians, "label", "frame_index").first().vector) == 18
    edges = spark.createDataFrame([(0, "nose", "mid")], "edge_index int, node_0 string, node_1 string")
    assert tracks.skeleton_edges(track, edges, ["id", "frame_index"]).count() == 3
    assert tracks.track_validity(track, ["id"]).first().repeated_keys == 0


def test_text(spark):
    fields = text.extract_fields(F.lit("mouse_12_day3_mouse.csv"), {"animal": r"mouse_(\d+)", "day": r"day(\d)"})
    r = one(spark, *(c.alias(k) for k, c in fields.items()), text.readable_bytes(F.lit(1536)).alias("size"), text.duration_text(F.lit(93784)).alias("d"), text.json_at(F.lit('{"a": [1, {"b c": 5}]}'), ["a", 1, "b c"]).alias("j"))
    assert (r.animal, r.day, r["size"], r.d, r.j) == ("12", "3", "1.5 KB", "1 days 02:03:04", "5")
    r = one(spark, text.int_synonym(F.array(F.lit(0), F.lit(25))).alias("s"), text.synonym_ints(F.lit("az")).alias("i"), text.nearest_multiple(F.lit(7.5), F.lit(5)).alias("n"))
    assert (r.s, r.i, r.n) == ("az", [0, 25], 10.0)


def test_arrays(spark):
    a = F.array(*map(F.lit, "aabbbc"))
    r = one(spark, arrays.collapse(a).alias("c"), arrays.run_lengths(a).alias("l"), arrays.chunks(a, 4).alias("k"), arrays.hamming_matches(F.array(*map(F.lit, "abcab")), F.array(*map(F.lit, "abd")), 1).alias("h"), arrays.zip_to(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3)), F.lit(2), F.lit(0)).alias("z"))
    assert r.c == ["a", "b", "c"] and r.l == [2, 3, 1] and [len(k) for k in r.k] == [4, 2] and [(h.start, h.wrong) for h in r.h] == [(0, [2])] and [tuple(z) for z in r.z] == [(1, 2), (0, 3)]


def test_rasters(spark):
    cells = spark.createDataFrame([(1, 5, 5), (1, 5, 7)], "id long, row int, col int")
    assert raster.dilate(cells, ["id"]).count() == 15
    assert {(r.row, r.col) for r in raster.clean(cells, ["id"]).collect()} == {(5, 5), (5, 6), (5, 7)}
    import zlib

    packed = ":".join(f"{b:x}" for b in zlib.compress(bytes([0, 1, 0, 0, 0, 1])))
    df = spark.createDataFrame([(1, packed, 3)], "id long, t string, w int")
    assert {(r.row, r.col) for r in raster.raster_cells(df, ["id"], "t", "w").collect()} == {(0, 1), (1, 2)}
    assert raster.mark(raster.grid(spark, (0, 4), (0, 4)), [raster.disc(2, 2, 1)]).where("inside").count() == 5


def test_projections(spark):
    df = spark.createDataFrame([(1, "b", '{"k": 3}'), (2, "a", None)], "id long, g string, j string")
    assert {(r.id, r.k) for r in columns.expand_json(df, "j", "k int").collect()} == {(1, 3), (2, None)}
    numbered, mapping = columns.key_numbers(df, ["g"])
    assert {(r.combined_idx, r.id) for r in numbered.collect()} == {(1, 1), (0, 2)} and mapping.count() == 2
    off, on = columns.split_by(df, F.col("id") == 1, ["g"])
    assert [r.g for r in off.orderBy("id").collect()] == [None, "a"] and [r.g for r in on.orderBy("id").collect()] == ["b", None]
    floats = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(floats).where("x IS NULL").count() == 1


def test_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a/one_1.parquet")
    files.write_table(spark.range(2).withColumn("v", F.lit("x")), f"{tmp_path}/b/two_2.csv")
    both = files.read_and_stack(spark, [f"{tmp_path}/a/one_1.parquet", f"{tmp_path}/b/two_2.csv"])
    assert both.count() == 5 and "input_path" in both.columns
    with pytest.raises(KeyError):
        files.read_table(spark, "x.unknown")
    found = files.file_table(spark, f"{tmp_path}/a", r"(\w+)_(\d)\.parquet/", ["name", "n"], "*.parquet")
    assert {(r.name, r.n) for r in found.collect()} == {("one", "1")}
    r = one(spark, *(c.alias(k) for k, c in files.name_fields(F.lit("/x/m1_d2_rest.csv"), ["m", "d"]).items()), files.first_label(F.lit("abc"), {"p": "b", "q": "a"}).alias("l"))
    assert tuple(r) == ("m1", "d2", "q")
    wide = spark.createDataFrame([(0, 1.0, 2.0, 0.9)], ["frame_index", "nose.x", "nose.y", "nose.score"])
    assert tuple(files.keypoint_columns_to_long(wide, ["frame_index"]).first()) == (0, "nose", 0.9, 1.0, 2.0)


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/t.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (k INTEGER, v REAL, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, i / 2, f"s{i}") for i in range(250)])
    assert sqlite_tables(path) == ["t"]
    df = read_sqlite_table(spark, path, "t", rows_per_partition=100)
    assert df.count() == 250 and {r.k for r in df.where("k BETWEEN 5 AND 7").collect()} == {5, 6, 7}


def test_cache(spark, tmp_path):
    calls = []

    @cached
    def make(session, n):
        calls.append(n)
        return session.range(n)

    path = f"{tmp_path}/c"
    assert [make(spark, n, cache_path=path, cache_overwrite=o).count() for n, o in ((3, False), (4, False), (5, True))] == [3, 3, 5] and calls == [3, 5]


def test_streaming_bouts(spark, tmp_path):
    from ethoframe.streaming.bouts import windowed_counts

    src = f"{tmp_path}/src"
    spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:20:00", "b")], "t string, label string").select(F.col("t").cast("timestamp").alias("t"), "label").write.parquet(src)
    stream = spark.readStream.schema("t timestamp, label string").parquet(src)
    q = windowed_counts(stream, "t", "label").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.label, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
