"""Assignments, disjoint sets, trees, JSON in texts, polygons and draws against brute force."""

import json
import random
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoframe.functions import trees
from ethoframe.operators import assignment, disjoint, draws, polygons


@pytest.mark.parametrize("maximize", [False, True])
def test_anchored_assignment(spark, maximize):
    rng = np.random.default_rng(1)
    rows = []
    for p in range(60):
        for g in range(4):
            for i in range(rng.integers(1, 6) if g else rng.integers(1, 6)):
                rows.append((p, g, f"{g}-{i}", rng.integers(0, 9, 3).astype(float).tolist()))
    rows += [(99, 0, "0-0", [1.0, 2.0, 3.0]), (99, 1, None, [1.0, 1.0, 1.0]), (99, 2, "2-0", None), (98, 1, "1-0", [0.0, 0.0, 0.0]), (97, 0, "same", [1.0, 1.0, 1.0]), (97, 1, "a", [1.0, 1.0, 1.0]), (97, 1, "b", [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "p int, g int, item string, v array<double>").repartition(3)
    found = assignment.assign_to_anchor(df, ["p"], "g", F.col("g") == 0, "item", "v", maximize=maximize)
    got = defaultdict(dict)
    for r in found.collect():
        got[r.p, r.g][r.anchor] = (r.partner, r.cost)
    vectors = {(p, i): np.array(v) for p, g, i, v in rows if v is not None and i is not None}
    by = defaultdict(list)
    for p, g, i, v in rows:
        if i is not None and v is not None:
            by[p, g].append(i)
    assert set(got) == {(p, g) for p, g in by if g and (p, 0) in by}
    for (p, g), matched in got.items():
        anchors, others = sorted(by[p, 0]), by[p, g]
        assert sorted(matched) == anchors
        partners = [x for x, _ in matched.values() if x is not None]
        assert len(set(partners)) == len(partners) == min(len(anchors), len(others)) and set(partners) <= set(others)
        mse = lambda a, b: float(np.square(vectors[p, a] - vectors[p, b]).mean())  # noqa: E731, B023
        for a, (b, cost) in matched.items():
            assert (b is None) == (cost is None) and (b is None or cost == pytest.approx(mse(a, b)))
        small, large = sorted((anchors, others), key=len)
        totals = [sum(map(mse, small, x)) for x in permutations(large, len(small))]
        assert sum(c for _, c in matched.values() if c is not None) == pytest.approx(max(totals) if maximize else min(totals))
    whole = {(r.p, r.anchor): r.partners for r in assignment.aligned_groups(found, ["p"], "g").collect()}
    assert all(whole[p, a][g] == b for (p, g), m in got.items() for a, (b, _) in m.items())


def test_matching_of_larger_batches():
    rng = np.random.default_rng(2)
    for n, m in ((7, 7), (3, 9), (1, 1), (6, 8)):
        costs = rng.integers(-20, 20, (40, n, m)).astype(float)
        partner = assignment.match_batch(costs)
        for c, p in zip(costs, partner, strict=True):
            assert len(set(p.tolist())) == n
            assert c[np.arange(n), p].sum() == min(c[np.arange(n), list(x)].sum() for x in permutations(range(m), n))


def exhaustive(sets):
    """(most members, all choices that reach it) of {set: members}."""
    best, found = 0, []
    names = sorted(sets)
    for k in range(len(names) + 1):
        for choice in combinations(names, k):
            n = sum(len(sets[s]) for s in choice)
            if len(set().union(*(sets[s] for s in choice))) == n:
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append(list(choice))
    return best, sorted(found)


@pytest.fixture
def set_rows():
    rng = random.Random(4)
    rows = [(p, s, rng.randint(0, 14)) for p in range(12) for s in range(rng.randint(1, 8)) for _ in range(rng.randint(1, 4))]
    rows += [(50, 1, 1), (50, 2, 1), (50, 3, 2), (50, 4, 2)]  # ties in two components
    sets = defaultdict(lambda: defaultdict(set))
    for p, s, m in rows:
        sets[p][s].add(m)
    return rows + rows[:20] + [(60, 1, None), (60, None, 3)], sets


def test_max_disjoint_sets(spark, set_rows):
    rows, sets = set_rows
    df = spark.createDataFrame(rows, "p int, s int, m int")
    got = defaultdict(list)
    for r in disjoint.max_disjoint_sets(df, ["p"], "s", "m").collect():
        got[r.p].append(r.set)
    assert {p: sorted(s) for p, s in got.items()} == {p: exhaustive(s)[1][0] for p, s in sets.items()}
    every = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in disjoint.max_disjoint_sets(df, ["p"], "s", "m", alternatives=True).collect():
        every[r.p][r.component][r.choice].append(r.set)
    for p, parts in every.items():
        whole = [[]]
        for choices in parts.values():
            whole = [w + c for w in whole for c in choices.values()]
        assert sorted(map(sorted, whole)) == exhaustive(sets[p])[1]


def test_condense_disjoint(spark, set_rows):
    rows, sets = set_rows
    got = defaultdict(lambda: defaultdict(list))
    for r in disjoint.condense_disjoint(spark.createDataFrame(rows, "p int, s int, m int"), ["p"], "s", "m").collect():
        got[r.p][r.choice].append(r.set)
    for p, all_sets in sets.items():
        left, choices = dict(all_sets), []
        while left:
            first = min(left)
            rest = {s: m for s, m in left.items() if s != first and not m & left[first]}
            choices.append([first, *exhaustive(rest)[1][0]])
            for s in choices[-1]:
                del left[s]
        assert [sorted(got[p][k]) for k in sorted(got[p])] == [sorted(c) for c in choices]


def test_disjoint_sets_of_packed_and_cut_problems(spark, set_rows, monkeypatch):
    rows, sets = set_rows
    df = spark.createDataFrame([*rows, *((None, s, m) for p, s, m in rows if p == 3)], "p int, s int, m int")
    for float_members in (False, True):
        given = df.withColumn("m", df.m.cast("double")) if float_members else df
        found = []
        for packed in (4096, 8, 0):
            monkeypatch.setattr(disjoint, "PACKED", packed)
            found.append(sorted(map(tuple, disjoint.max_disjoint_sets(given, ["p"], "s", "m", alternatives=True).collect()), key=repr))
        assert found[0] == found[1] == found[2]
        assert sorted(r[3] for r in found[0] if r[0] is None and r[2] == 0) == sorted(exhaustive(sets[3])[1][0])


def test_condensing_makes_no_rows_of_pairs(spark, set_rows, monkeypatch):
    monkeypatch.setattr(disjoint, "conflicts", None)
    monkeypatch.setattr(disjoint, "materialize", None)
    rows, sets = set_rows
    found = disjoint.condense_disjoint(spark.createDataFrame(rows, "p int, s int, m int"), ["p"], "s", "m")
    assert sorted((r.p, r.set) for r in found.collect()) == sorted((p, s) for p in sets for s in sets[p])


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([None, True, False, 0, -7, 12.5, "", "text", 'q"\\u', "é<&>", {}, []])
    if rng.random() < 0.5:
        return [random_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    return {rng.choice(["a", "b c", "d.e", "[0]", 'k"', "ü", "zz"]): random_tree(rng, depth - 1) for _ in range(rng.randint(1, 4))}


def leaves_of(tree, path=()):
    if isinstance(tree, dict) and tree:
        return [x for k, v in tree.items() for x in leaves_of(v, (*path, k))]
    if isinstance(tree, list) and tree:
        return [x for i, v in enumerate(tree) for x in leaves_of(v, (*path, i))]
    return [(path, tree)]


def test_json_trees(spark):
    rng = random.Random(3)
    made = {i: random_tree(rng, 6) for i in range(80)} | {80: {"a": {"b": {"c": {"d": {"e": [1, {"f": 2}]}}}}}}
    rows = [(i, json.dumps(t)) for i, t in made.items()] + [(900, None), (901, "not json"), (902, "")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("tree", trees.json_tree(F.col("text")))
    leaves = trees.leaf_paths(df, ["id"], "tree")
    got = defaultdict(list)
    for r in leaves.collect():
        got[r.id].append((tuple(s.key if s.key is not None else s.pos for s in r.path), json.loads(r.json)))
    assert {i: sorted(x, key=repr) for i, x in got.items()} == {i: sorted(leaves_of(t), key=repr) for i, t in made.items()}
    back = {r.id: json.loads(r.json) for r in trees.tree_text(leaves, ["id"]).collect()}
    assert back == made


def test_set_values_in_trees(spark):
    trees_ = {1: {"a": {"b": 1, "c": [1, 2]}, "x": 5}, 2: {"a": 3}, 3: {"y": None}}
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in trees_.items()], "id int, text string").withColumn("tree", trees.json_tree(F.col("text")))
    leaves = trees.leaf_paths(df, ["id"], "tree")
    values = leaves.select("id").distinct().select("id", trees.path_of("a", "c").alias("path"), F.lit('{"new":true}').alias("json"))
    back = {r.id: json.loads(r.json) for r in trees.tree_text(trees.set_values(leaves, ["id"], values), ["id"]).collect()}
    new = {"new": True}
    assert back == {1: {"a": {"b": 1, "c": new}, "x": 5}, 2: {"a": {"c": new}}, 3: {"a": {"c": new}, "y": None}}


def test_xml_trees(spark):
    xml = '<r id="7" on="true"><a><b><c><d k="v&quot;&lt;">t &amp; u</d></c></b></a><e/><p q="1">x</p><p>2.5</p></r>'
    df = spark.createDataFrame([(1, xml), (2, None)], "id int, x string")
    typed = trees.leaf_paths(df.withColumn("tree", trees.xml_tree(F.col("x"))), ["id"], "tree")
    got = {(r.id, r.p): json.loads(r.json) for r in typed.select("id", trees.path_text(F.col("path")).alias("p"), "json").collect()}
    assert got == {(1, "@id"): 7, (1, "@on"): True, (1, "a.b.c.d.@k"): 'v"<', (1, "a.b.c.d.#text"): "t & u", (1, "e"): None, (1, "p[0].@q"): 1, (1, "p[0].#text"): "x", (1, "p[1]"): 2.5}
    plain = trees.leaf_paths(df.withColumn("tree", trees.xml_tree(F.col("x"), types=False)), ["id"], "tree")
    (back,) = trees.xml_text(plain, ["id"], "r").collect()
    assert ET.canonicalize(back.xml) == ET.canonicalize(xml)


def cubic(text):
    found = []
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if text[i] in "{[" and text[j - 1] in "}]":
                try:
                    json.loads(text[i:j])
                    found.append((i, j - i, text[i:j]))
                except ValueError:
                    pass
    return found


def test_json_in_texts(spark):
    rng = random.Random(8)
    pieces = ['{"a": 1}', "[", "]", "{", "}", '"', "\\", '\\"', "[1, 2]", '{"b": "}"}', "x", ":", ",", "null", " ", '{"c": [', "]}", '"k": ', "é", "[]", "{}"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(400)] + [None, "", '{"a": "\\"}"} tail', '"[1]" {"x": "a]b"}', "[" * 50 + "]" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = defaultdict(list)
    for r in trees.json_spans(df, ["id"], "t").collect():
        got[r.id].append((r.start, r.length, r.json))
    want = {i: cubic(t or "") for i, t in enumerate(texts)}
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items() if x}
    longest = {r.id: r.json for r in trees.longest_json(df, ["id"], "t").collect()}
    assert longest == {i: max(x, key=lambda s: (s[1], -s[0]))[2] for i, x in want.items() if x}


def even_odd(points, rows, cols):
    cells = set()
    for r in range(rows):
        for c in range(cols):
            n = 0
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
                if ay > by:
                    ax, ay, bx, by = bx, by, ax, ay
                n += ay <= r < by and ax + (r - ay) * (bx - ax) / (by - ay) > c
            if n % 2:
                cells.add((r, c))
    return cells


def test_polygon_fill(spark):
    rng = random.Random(5)
    shapes = [[(1.0, 1.0), (8.0, 1.0), (8.0, 6.0), (1.0, 6.0)], [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.5), (0.0, 10.0)], [(-5.0, -5.0), (30.0, 4.0), (2.0, 40.0)], [(1.0, 1.0), (5.0, 5.0)], [(3.0, 3.0)] * 4]
    shapes += [[(rng.uniform(-3, 22), rng.uniform(-3, 18)) for _ in range(rng.randint(3, 9))] for _ in range(40)]
    shapes += [[(float(rng.randint(0, 15)), float(rng.randint(0, 15))) for _ in range(rng.randint(3, 9))] for _ in range(40)]
    rows = [(i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(shapes)] + [(900, None), (901, []), (902, [{"x": None, "y": 1.0}] * 5)]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>")
    spans = polygons.scanline_intervals(df, ["id"], "points", (16, 20))
    got = defaultdict(set)
    cells = polygons.interval_cells(spans, ["id"]).collect()
    for r in cells:
        got[r.id].add((r.row, r.col))
    assert len(cells) == sum(map(len, got.values()))
    assert dict(got) == {i: c for i, p in enumerate(shapes) if (c := even_odd(p, 16, 20))}
    areas = {r.id: (r.n_cells, r.row, r.col) for r in polygons.interval_areas(spans, ["id"]).collect()}
    assert areas == {i: (len(c), pytest.approx(np.mean([r for r, _ in c])), pytest.approx(np.mean([x for _, x in c]))) for i, c in got.items()}
    masks = spans.withColumns({"mask": F.col("id"), "id": F.col("id") % 7})
    for least, n in ((1, 1), (2, 2), (3, 3)):
        found = Counter((r.id, r.row, r.col) for r in polygons.interval_cells(polygons.combine_intervals(masks, ["id"], "mask", least), ["id"]).collect())
        covered = Counter((i % 7, *c) for i, cs in got.items() for c in cs)
        assert found == {k: 1 for k, v in covered.items() if v >= n}


def test_draws_by_weight(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("k"), F.array(*map(F.lit, "abcd")).alias("v"), F.array(*map(F.lit, [1.0, 0.0, 3.0, 6.0])).alias("w"))
    pick = lambda d: Counter((r.k, r.x) for r in d.select("k", draws.choose(F.col("v"), F.col("w"), draws.uniform(["k"], 5)).alias("x")).collect())
    first = pick(df)
    assert first == pick(df.repartition(7, "k")) and first != pick(df.withColumn("k", F.col("k") + 1))
    shares = Counter(x for _, x in first)
    assert shares["b"] == 0
    for x, p in (("a", 0.1), ("c", 0.3), ("d", 0.6)):
        assert abs(shares[x] - n * p) < 5 * (n * p * (1 - p)) ** 0.5
    uniform = Counter(r.x for r in df.select(draws.choose_uniform(F.col("v"), draws.uniform(["k"], 9)).alias("x")).collect())
    assert all(abs(uniform[x] - n / 4) < 5 * (n * 3 / 16) ** 0.5 for x in "abcd")
    odd = spark.sql("select array('a', 'b') v, array(null, 2D) w union all select array('a'), array(0D) union all select array(), array() union all select null, null")
    assert [r.x for r in odd.select(draws.choose(F.col("v"), F.col("w"), F.lit(0.5)).alias("x")).collect()] == ["b", None, None, None]


def test_rows_drawn_with_replacement(spark):
    weights = {i: [0.5, 1.0, 2.0, 40.0, 0.0, -1.0, None][i % 7] for i in range(70)}
    df = spark.createDataFrame(list(weights.items()), "k int, weight double").repartition(3)
    n = 30_000
    asked = spark.range(n).withColumnRenamed("id", "draw")
    got = draws.draw_rows(df, ["k"], "weight", asked, ["draw"], seed=2).select("draw", "k").collect()
    assert len(got) == n and Counter(map(tuple, got)) == Counter(map(tuple, draws.draw_rows(df.repartition(5), ["k"], "weight", asked.repartition(4), ["draw"], seed=2).select("draw", "k").collect()))
    total = sum(w for w in weights.values() if w and w > 0)
    counts = Counter(r.k for r in got)
    for k, w in weights.items():
        p = max(w or 0, 0) / total
        assert abs(counts[k] - n * p) <= 5 * (n * p * (1 - p)) ** 0.5


def test_rows_drawn_without_replacement(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 == 0, 50.0).otherwise(1.0).alias("w"))
    got = draws.sample_without_replacement(df, ["k"], "w", 40, ["g"], seed=1).collect()
    again = draws.sample_without_replacement(df.repartition(9), ["k"], "w", 40, ["g"], seed=1, salts=3).collect()
    assert Counter(r.g for r in got) == {0: 40, 1: 40, 2: 40} and {r.k for r in got} == {r.k for r in again}
    assert sum(r.k % 10 == 0 for r in got) > 70  # a tenth of the rows, 85 % of the weight
    assert {r.k for r in draws.sample_without_replacement(df, ["k"], "w", 5).collect()} == {r.k for r in draws.sample_without_replacement(df.repartition(2), ["k"], "w", 5).collect()}
    assert draws.sample_without_replacement(df, ["k"], "w", 5000, ["g"]).count() == 3000


def test_runs_of_a_series_without_ids_by_blocks(spark, monkeypatch):
    from ethoframe.operators import runs

    rng = random.Random(11)
    at = sorted(rng.sample(range(-300, 700), 500))
    rows = [(i, rng.choice(["a", "a", "a", "b", None]) if not 100 < i < 250 else "a") for i in at]
    df = spark.createDataFrame(rows, "frame_index long, v string").repartition(5)
    for gap in (False, True):
        want = sorted((r.start_index, r.end_index, r.run_length, r.run_value) for r in runs.run_length_encode(df.selectExpr("1 AS k", "*"), "v", ["k"], break_on_gap=gap).collect())
        for block in (7, 50, 10_000):
            monkeypatch.setattr(runs, "FLAT_BLOCK", block)
            assert sorted(tuple(r) for r in runs.run_length_encode(df, "v", (), break_on_gap=gap).collect()) == want
    assert runs.run_length_encode(df.limit(0), "v", ()).count() == 0


def test_merged_boxes_equal_merging_one_by_one(spark):
    from ethoframe.functions import geometry

    rng = random.Random(4)
    boxes = [(k, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randint(1, 9)), float(rng.randint(1, 9))) for k in range(4) for _ in range(12)]
    want = set()
    for k in range(4):
        left = list({b[1:] for b in boxes if b[0] == k})
        while True:
            met = next(((a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]), None)
            if met is None:
                break
            a, b = met
            x, y = min(a[0], b[0]), min(a[1], b[1])
            left = list({c for c in left if c not in met} | {(x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)})
        want |= {(k, *b) for b in left}
    df = spark.createDataFrame(boxes, "k int, x double, y double, w double, h double").selectExpr("k", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS box")
    assert {(r.k, *r.box) for r in geometry.merge_boxes(df, ["k"]).collect()} == want
