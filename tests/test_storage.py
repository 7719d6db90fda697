"""Segments, linkage, folders of files in one scan, and the SQLite writer against brute force."""

import os
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoframe.operators import linkage, segments
from ethoframe.sources import files
from ethoframe.sources.sqlite import read_sqlite_table, sqlite_tables, write_sqlite, write_sqlite_table


def test_blocks_cover_a_segment_once(spark):
    rng = random.Random(2)
    cuts = [(a, a + n) for a in range(0, 20) for n in range(0, 20)] + [(a := rng.randint(0, 10**6), a + rng.randint(0, 10**5)) for _ in range(50)] + [(5, 4), (5, 0), (None, 3), (3, None)]
    df = spark.createDataFrame(cuts, "a long, b long").select("a", "b", segments.blocks_of(F.col("a"), F.col("b")).alias("blocks"))
    for r in df.collect():
        if r.a is None or r.b is None or r.b < r.a:
            assert not r.blocks
            continue
        covered = sorted(f for x in r.blocks for f in range(x.block << x.level, (x.block + 1) << x.level))
        assert covered == list(range(r.a, r.b + 1)) and len(r.blocks) <= 2 * (r.b - r.a + 1).bit_length()


def test_segment_extremes(spark):
    rng = random.Random(3)
    frames = [(i, f, rng.choice([None, rng.uniform(-9, 9)]), rng.uniform(0, 5)) for i in range(3) for f in range(0, 300, 1 + i)]
    cuts = [(k, rng.randint(0, 3), rng.randint(0, 320), rng.choice([None, 1, 5, 60, 400])) for k in range(120)]
    cuts = [(k, i, a, None if n is None else a + n - 2) for k, i, a, n in cuts] + [(500, 1, 3, 9), (500, 1, 3, 9)]
    track = spark.createDataFrame(frames, "id int, frame_index long, x double, y double")
    spans = spark.createDataFrame(cuts, "k int, id int, a long, b long").repartition(3)
    got = segments.segment_extremes(spans, track, ["id"], "a", "b", ["x"], ["y"]).collect()
    assert len(got) == len(cuts)
    for r in got:
        inside = [(x, y) for i, f, x, y in frames if i == r.id and x is not None and r.b is not None and r.a <= f <= r.b]
        assert (r.x, r.y, r.n_frames) == (min((x for x, _ in inside), default=None), max((y for _, y in inside), default=None), len(inside))


def agglomerated(distances):
    """Merges by the least of the greatest distances between clusters; ties by the clusters' names."""
    clusters = {x: {x} for pair in distances for x in pair}
    d = lambda a, b: max(distances[tuple(sorted((x, y)))] for x in clusters[a] for y in clusters[b])
    out = []
    while len(clusters) > 1:
        height, a, b = min((d(a, b), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] |= clusters.pop(b)
        out.append((a, b, height, len(clusters[a])))
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "line"])
def test_complete_linkage(spark, kind):
    rng = np.random.default_rng(6)
    points = {"plain": rng.normal(size=(17, 3)), "ties": rng.integers(0, 3, (12, 2)).astype(float), "line": np.arange(9.0)[:, None] ** 2}[kind]
    distances = {(i, j): float(np.abs(points[i] - points[j]).sum()) for i in range(len(points)) for j in range(i + 1, len(points))}
    df = spark.createDataFrame([(b, a, d) if (a + b) % 2 else (a, b, d) for (a, b), d in distances.items()], "a int, b int, distance double").repartition(3)
    got = sorted((r.left, r.right, r.height, r.size) for r in linkage.complete_linkage(df).collect())
    assert [g[2:] for g in sorted(got, key=lambda g: g[2:])] == [pytest.approx(w[2:]) for w in sorted(agglomerated(distances), key=lambda w: w[2:])]
    if kind != "ties":
        assert got == [pytest.approx(w) for w in agglomerated(distances)]


def test_linkage_of_nothing(spark):
    empty = spark.createDataFrame([(1, 2, None)], "a int, b int, distance double")
    assert linkage.complete_linkage(empty).columns == ["left", "right", "height", "size"] and linkage.complete_linkage(empty).count() == 0


def test_a_thousand_track_files_in_one_scan(spark, tmp_path):
    rng, want = random.Random(4), set()
    for i in range(1000):
        tracks = ["track_0"] if i % 3 else ["track_0", "track_1"]
        columns = ["nose.x", "nose.y"] if i % 2 else ["nose.y", "tail.x"]
        lines = [",".join(["track", "frame_idx", *columns])]
        for t in tracks:
            for f in range(2):
                values = {c: rng.choice([None, rng.randint(0, 99) / 4]) for c in columns}
                lines.append(",".join([t, str(f), *("" if v is None else str(v) for v in values.values())]))
                want.add((f"rec.{i}" + (f"_{t.replace('_', '')}" if len(tracks) > 1 else ""), f, *(values.get(c) for c in ("nose.x", "nose.y", "tail.x"))))
        folder = tmp_path / f"day{i % 5}"
        folder.mkdir(exist_ok=True)
        (folder / f"rec.{i}.csv").write_text(("\r\n" if i % 7 == 0 else "\n").join(lines) + "\n")
    df = files.track_folder(spark, str(tmp_path))
    assert df.columns == ["recording", "frame_index", "nose.x", "nose.y", "tail.x"]
    assert set(map(tuple, df.collect())) == want and df.count() == len(want)


def test_sqlite_writer(spark, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.range(2500).select(F.col("id"), (F.col("id") / 4).alias("v"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t'"), "id")).alias("select"), (F.col("id") % 2 == 0).alias("even"), F.lit(b"\x00\x01").alias("b")).repartition(4)
    rows = lambda t="t": sorted(map(tuple, read_sqlite_table(spark, path, t).collect()))
    want = sorted(map(tuple, df.collect()))
    write_sqlite_table(df, path, "t")
    assert rows() == want
    write_sqlite_table(df.limit(0), path, "t", "append")
    write_sqlite_table(df.where("id < 10").select("even", "b", "v", "select", "id"), path, "t", "append")
    assert rows() == sorted(want + [r for r in want if r[0] < 10])
    with pytest.raises(ValueError, match="has a table"):
        write_sqlite_table(df, path, "t", "fail")
    write_sqlite({"t": df.where("id < 5"), "u v": df.limit(3), "none": df.limit(0)}, path)
    assert rows() == [r for r in want if r[0] < 5] and len(rows("u v")) == 3 and rows("none") == [] and sqlite_tables(path) == ["none", "t", "u v"]
    assert os.listdir(tmp_path) == ["x.db"]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "x.db")
    write_sqlite_table(spark.range(10), path, "t")
    bad = spark.range(1000, numPartitions=4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    for mode in ("replace", "append"):
        with pytest.raises(Exception, match="no"):
            write_sqlite_table(bad, path, "t", mode)
        with sqlite3.connect(path) as db:
            assert db.execute("SELECT count(*), sum(id) FROM t").fetchone() == (10, 45)
    assert os.listdir(tmp_path) == ["x.db"]
