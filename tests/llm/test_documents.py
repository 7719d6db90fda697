"""The operators on documents against plain Python, with nulls, empty and long texts, copies, ties, empty tables and clashing columns."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ethoframe.llm import decontaminate, jaccard, licenses, lines, mixing, quality, substrings, tokens
from ethoframe.llm.graph import components


def pairs(documents):
    return [(d, t) for d, t, *_ in documents]


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_hashed_words_match_bytes_split(documents):
    texts = [t for _, t in pairs(documents)]
    for lower in (False, True):
        seen, names = {}, {}
        array = pa.array([None, *texts]).slice(1)  # an array that does not begin at 0
        h, starts = tokens.hashed(array, lower)
        for i, t in enumerate(texts):
            words = (t or "").encode()
            words = (words.lower() if lower else words).split()
            got = h[starts[i] : starts[i + 1]].tolist()
            assert len(got) == len(words)
            for w, x in zip(words, got, strict=True):
                assert seen.setdefault(w, x) == x and names.setdefault(x, w) == w


def test_licenses(docs, documents):
    got = by_id(licenses.license_report(docs), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == brute.licenses(pairs(documents))


def test_license_templates_and_containment(spark):
    words = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    cut = " ".join(words.split()[:18])
    rows = [(1, f"noise {words} noise"), (2, f"noise {cut} gone"), (3, "CC BY-NC 4.0"), (4, "Licensed under CC BY-NC 4.0."), (5, "x " * 500 + words.upper())]
    got = by_id(licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")), "labels", "score")
    assert got[1] == ("bsd", 1.0) and got[4] == ("cc-by-nc", 1.0) and got[3][0] == "" and got[5][0] == "bsd"
    assert got[2][0] == "bsd" and 0.85 <= got[2][1] < 1


def test_line_dedup(docs, documents):
    kept = brute.line_keepers(pairs(documents))
    got = by_id(lines.dedup_lines(docs), "text", "n_lines", "n_removed")
    for d, t in pairs(documents):
        raw = (t or "").split("\n")
        want = None if t is None else "\n".join(x for n, x in enumerate(raw) if kept.get((d, n), True))
        assert got[d] == (want, sum((d, n) in kept for n in range(len(raw))), sum(not kept.get((d, n), True) for n in range(len(raw))))


def test_line_dedup_finds_near_lines_of_all_lengths(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = []
    for n, size in enumerate((12, 17, 19, 22, 40, 200)):  # around the border between full and sampled signatures
        base = [word() for _ in range(size)]
        for copy in range(5):
            changed = list(base)
            changed[int(rng.integers(size))] = word() if copy else changed[0]
            rows.append((10 * n + copy, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, kept = by_id(lines.dedup_lines(df), "n_removed"), brute.line_keepers(rows)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(not k for k in kept.values()) > 0
    assert all(not v[0] or not kept[(d, 0)] for d, v in got.items())


def test_line_dedup_finds_twins_among_templated_lines(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    head, rows = text(89) + "x", []
    for n in range(600):  # twins at 0.76, all others at 0.66
        tail = "y" + text(19) + "y"
        rows += [(2 * n, head + tail), (2 * n + 1, head + tail[:7] + text(13) + "z" if n < 300 else head + "z" + text(19) + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, kept = by_id(lines.dedup_lines(df), "n_removed"), brute.line_keepers(rows)
    gone = {d for d, v in got.items() if v[0]}
    want = {d for (d, _), k in kept.items() if not k}
    assert gone <= want and len(gone) >= 0.99 * len(want) > 250


def test_line_dedup_counts_distinct_shingles(spark):
    phrase = " ".join(f"{i * i:03d}" for i in range(7, 32))  # 100 characters
    shapes = ["=" * 40, "=" * 120, "-" * 200, "-" * 137, "BUY!! NOW!! " * 20, "BUY!! NOW!! " * 40, "*" * 3000, "*" * 12, (phrase + " ") * 2, (phrase + " ") * 3, (phrase + " ") * 30, "one two " * 9, "one two " * 400]
    rows = list(enumerate(shapes))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = brute.line_keepers(rows)
    got = by_id(lines.dedup_lines(df), "n_removed")
    assert {d: bool(v[0]) for d, v in got.items()} == {d: not kept[(d, 0)] for d, _ in rows} and sum(not k for k in kept.values()) == 7


def test_lines_of_middle_length_are_not_read_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    rows = [(n, "x" + text(178 + n % 200) + "x") for n in range(120)]
    rows += [(1000 + n, line[:-8] + text(7) + "z") for n, line in rows[:30]]
    counts, keep = {}, lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, label: [out := keep(df, label), counts.update({label: out.count()})][0])
    got, kept = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed"), brute.line_keepers(rows)
    assert {d: bool(v[0]) for d, v in got.items()} == {d: not kept[(d, 0)] for d, _ in rows} and sum(not k for k in kept.values()) == 30
    assert counts["lines-few"] == 0


def test_line_texts_are_cut_twice_and_blanks_at_their_ends_do_not_count(spark, monkeypatch):
    base = ["one line of prose that stands here", "another one, which has not much in common with it", "zwölf Boxkämpfer jagen Viktor über den großen Deich"]
    ends = [("", ""), (" ", "\t"), ("\x0b", ""), ("", "\r"), ("\f \t", " \x0b\r"), ("\u00a0", "")]
    rows = [(n, "\n".join(a + line + b for line in base) + "\n \t\r\x0b\f\n") for n, (a, b) in enumerate(ends)] + [(9, " \t"), (10, None), (11, "tab\tinside"), (12, "tab inside")]
    calls, cut = [], lines._lines
    monkeypatch.setattr(lines, "_lines", lambda *a: calls.append(a) or cut(*a))
    got, kept = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "n_lines", "n_removed"), brute.line_keepers(rows)
    for d, text in rows:
        judged = [n for n, line in enumerate((text or "").split("\n")) if line.strip(" \t\r\f\x0b")]
        assert got[d] == (len(judged), sum(not kept[(d, n)] for n in judged))
    assert len(calls) == 2


def test_line_buckets_of_any_size(spark):
    held = {1: [5], 2: [7, 3], 3: [4, -9, 8], 4: [2, 9, 1, 6, 5]}  # band: lines
    bands = {i: [b for b, ids in held.items() if i in ids] for i in sum(held.values(), [])}
    got = lines._buckets(spark.createDataFrame([*bands.items(), (11, None)], "id long, bands array<long>")).select("band", "id", "lo", "hi").collect()
    assert sorted(map(tuple, got)) == sorted((b, i, min(ids), max(ids)) for b, ids in held.items() if len(ids) > 1 for i in ids)


def test_substring_dedup(docs, documents):
    got = by_id(substrings.remove_repeats(docs).withColumn("sha", F.sha2("text", 256)), "n_words", "n_removed", "sha")
    assert got == brute.repeats(pairs(documents))


def test_hot_anchors_give_the_same_spans(docs, documents, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 1)
    got = by_id(substrings.remove_repeats(docs).withColumn("sha", F.sha2("text", 256)), "n_words", "n_removed", "sha")
    assert got == brute.repeats(pairs(documents))


@pytest.mark.parametrize("width", [9, 12, 50])
def test_other_windows(docs, documents, width):
    got = by_id(substrings.remove_repeats(docs, width).withColumn("sha", F.sha2("text", 256)), "n_words", "n_removed", "sha")
    assert got == brute.repeats(pairs(documents), width)


def test_automaton_counts_windows():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 3, int(n)).tolist() for n in rng.integers(4, 40, 30)]
    automaton, seen = substrings.Automaton(sequences), {}
    for s in sequences:
        for i in range(len(s) - 3):
            seen[tuple(s[i : i + 4])] = seen.get(tuple(s[i : i + 4]), 0) + 1
    for s in sequences:
        assert automaton.repeated(s, 4) == sum(1 << i for i in range(len(s) - 3) if seen[tuple(s[i : i + 4])] > 1)


def test_decontamination(spark, docs, documents):
    text = dict(pairs(documents))
    items = [(0, " ".join(text[30].split()[:40]) if len(text[30].split()) > 20 else text[5]), (1, text[5]), (2, "SAME same"), (3, None), (4, ""), (5, "never seen words"), (12, text[5]), (6, "ñandú Ñandú"), (7, "École école")]
    got = by_id(decontaminate.contamination_report(docs, spark.createDataFrame(items, "item_id long, text string")), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.leaks(pairs(documents), items)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "four three two one"), (3, "one far " + "y " * 30 + "two three four")], "doc_id long, text string")
    windows = decontaminate.windows_of(spark.createDataFrame([(1, "one two three four")], "item_id long, text string"))
    found = decontaminate.match_windows(*decontaminate.build_index(docs, windows), near=1.0)
    assert {(r.doc_id, r.match) for r in found.collect()} == {(1, "proximity"), (2, "proximity")}


def test_jaccard_classes(docs, documents):
    assert by_id(jaccard.jaccard_classes(docs), "n_shingles", "component_id") == brute.jaccard_classes(pairs(documents))


def test_jaccard_with_frequent_ngrams_and_large_columns(docs, documents, monkeypatch):
    for few, hot, chunk, tile in ((2, 2, 10, 2), (2, 3, 2_000_000, 5), (1, 10**9, 2_000_000, 2048)):
        monkeypatch.setattr(jaccard, "FEW", few), monkeypatch.setattr(jaccard, "HOT", hot), monkeypatch.setattr(jaccard, "CHUNK", chunk), monkeypatch.setattr(jaccard, "TILE", tile)
        assert by_id(jaccard.jaccard_classes(docs), "n_shingles", "component_id") == brute.jaccard_classes(pairs(documents))


def test_quality_votes(spark, docs):
    good = [(1000 + i, f"some plain words of prose number {i} that go on and on for a while") for i in range(60)]
    bad = [(2000 + i, f"BUY!! NOW!! CHEAP{i}!! OFFER!! BUY!! NOW!!") for i in range(60)]
    rows = spark.createDataFrame(good + bad + [(1, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 2000)) for d, _ in good + bad] + [(1, None), (None, 1), (999_999, 0)], "doc_id long, quality int")
    model = quality.fit(rows, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_documents(rows, model).collect()}
    assert all(got[d][1] == 1 for d, _ in good) and all(got[d][1] == 0 for d, _ in bad)
    assert got[1][0] == got[2][0] == pytest.approx(model.prior)
    none = quality.fit(rows, labels.where("false"))
    assert {r.score for r in quality.score_documents(rows, none).collect()} == {0.5}
    assert len(quality.fit(rows, labels, sample=10).labels) == 10


def test_quality_ignores_held_out_labels(spark):
    import zlib

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    model = quality.fit(rows, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"))
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))


def test_mixing(docs, documents):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(documents) and sorted(r.doc_id for r in got) == [d for d, *_ in documents]
    sizes = {d: len((t or "").encode().split()) for d, t in pairs(documents)}
    total, taken, target = {}, {}, {}
    for r in got:
        assert r.size == sizes[r.doc_id] and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        total[r.source] = total.get(r.source, 0) + r.size
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for r in got:
        assert r.source_size == total[r.source] and target[r.source] <= 3 * total[r.source] + 1e-6
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 5
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_targets_share_what_is_over():
    got = mixing.targets({"a": 10, "b": 100, "c": 1000, None: 10})
    assert got["a"] == 30 and got[None] == 30 and sum(got.values()) == pytest.approx(1120)
    assert got["b"] == 300 and got["c"] == pytest.approx(760)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (7, 6), (6, 8), (None, 1), (3, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6} | {100 + i: 100 for i in range(41)}


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (licenses.license_report(empty), lines.dedup_lines(empty), substrings.remove_repeats(empty), decontaminate.contamination_report(empty, items), jaccard.jaccard_classes(empty), mixing.mix_sources(empty), quality.score_documents(empty, quality.fit(empty, labels))):
        assert df.collect() == []


def test_clashing_columns_and_repeated_rows(spark, documents):
    rows = [(d, t, s, d, d, d, "x") for d, t, _, s, _ in documents]
    rows += rows[5:8]
    clash = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, n_words long, score long, key string")
    n = len(rows)
    items = spark.createDataFrame([(1, documents[5][1])], "item_id long, text string")
    labels = spark.createDataFrame([(9, 1)], "doc_id long, quality int")
    for df in (licenses.license_report(clash), lines.dedup_lines(clash), substrings.remove_repeats(clash), decontaminate.contamination_report(clash, items), jaccard.jaccard_classes(clash), mixing.mix_sources(clash), quality.score_documents(clash, quality.fit(clash, labels))):
        assert df.count() == n, df.columns
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(clash).collect()}
    assert removed[7] == len(documents[7][1].split())  # the row stands twice, so all its windows repeat


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "alpha beta gamma delta " * 20, "a"), (1, "alpha beta gamma delta " * 20, "a"), (None, None, None)], "doc_id long, text string, source string")
    for df in (licenses.license_report(rows), lines.dedup_lines(rows), substrings.remove_repeats(rows), jaccard.jaccard_classes(rows), mixing.mix_sources(rows)):
        assert df.count() == 3, df.columns


def test_rows_that_share_an_id_or_have_none_are_judged_each(spark):
    word = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    p, q = word("p", 50), word("q", 50)
    rows = [(1, p), (2, p), (1, q), (4, q + " tail"), (None, p + " end"), (None, word("z", 40)), (7, word("u", 60)), (7, q), (7, q), (8, ""), (8, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_row = lambda found: sorted((repr(rows[i][0]), *v) for i, v in found.items())
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    got = substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == by_row(brute.repeats(numbered))
    items = [(0, p), (1, word("z", 12))]
    report = decontaminate.contamination_report(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((repr(r[0]), *r[1:]) for r in report.drop("mark").collect()) == by_row(brute.leaks(numbered, items))
    clean = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in clean))) == sorted(repr(rows[i]) for i, v in brute.leaks(numbered, items).items() if not v[4])
    got = jaccard.jaccard_classes(df).collect()
    roots, ids = brute.jaccard_classes(numbered), [d for d, _ in rows]
    least = {c: min((ids[i] for i, v in roots.items() if v[1] == c and ids[i] is not None), default=None) for _, c in roots.values()}
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((ids[i], v[0], least[v[1]])) for i, v in roots.items())
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(df).collect()]
    cut = [(r.doc_id, r.text) for r in lines.dedup_lines(df).collect()]
    assert sorted(map(repr, cut)) == sorted(map(repr, [(1, ""), (2, ""), (1, q), (4, ""), (None, p + " end"), (None, word("z", 40)), (7, word("u", 60)), (7, ""), (7, ""), (8, ""), (8, None), (None, None)]))
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, p), (1, q), (None, word("z", 40)), (7, word("u", 60)), (8, ""), (8, None), (None, None)]))


def test_jaccard_of_one_large_group_of_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(jaccard, "TILE", 64)
    base, rows = [f"w{i}" for i in range(150)], []
    for n in range(400):
        words = list(base)
        for i in rng.integers(150, size=int(rng.integers(1, 14))):
            words[int(i)] = f"x{rng.integers(10**6)}"
        rows.append((n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compared = []
    real = jaccard.materialize

    def counted(df, label):
        out = real(df, label)
        if label == "ngram-compare":
            compared.append((label, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    assert by_id(jaccard.jaccard_classes(df), "n_shingles", "component_id") == brute.jaccard_classes(rows)
    assert sum(n for label, n in compared if label == "ngram-compare") < 16 * len(rows)  # of 79,800 pairs


@pytest.mark.parametrize("n", [3, 16, 1000, 4096])
def test_quality_votes_break_ties_by_position(n):
    """More neighbours at one cosine than votes: those first in the sample vote."""
    rng = np.random.default_rng(n)
    vectors = np.zeros((n, quality.DIMENSIONS), np.float32)
    vectors[np.arange(n), rng.integers(0, 3, n)] = 1
    labels = rng.integers(0, 2, n).astype(np.float32)
    axes = np.eye(quality.FEATURES, quality.DIMENSIONS, dtype=np.float32)
    model = quality.Model(np.ones(quality.FEATURES, np.float32), axes, vectors, labels)
    x = np.zeros((40, quality.FEATURES), np.float32)
    x[np.arange(40), rng.integers(0, 5, 40)] = 1
    for row, score in zip(x, quality.vote(model, x), strict=True):
        cosine = vectors @ row[: quality.DIMENSIONS]
        near = sorted(range(n), key=lambda i: (-cosine[i], i))[: quality.NEIGHBOURS]
        total = sum(cosine[i] for i in near)
        assert score == pytest.approx(sum(cosine[i] * labels[i] for i in near) / total if total else model.prior)


def test_repeated_rows_have_their_passages_once_each(spark, monkeypatch):
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(50_000)) for _ in range(150))
    shipped, cut = [], substrings._texts_of

    def counted(joined, width):
        shipped.append(cut(joined, width))
        return shipped[-1]

    monkeypatch.setattr(substrings, "_texts_of", counted)
    sizes = []
    for times in (100, 200, 400):
        variant = text.rsplit(" ", 10)[0] + " other words at the end"
        df = spark.createDataFrame([(None, text)] * times + [(1, variant)], "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect()}
        assert got == {(None, 150, 150), (1, 145, 140)}
        sizes.append(shipped[-1].count())
    assert sizes[2] - sizes[1] == 2 * (sizes[1] - sizes[0])


def test_quality_sample_is_cut_before_it_is_collected(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), sample=8)
    assert len(model.labels) == 8 and model.labels.all()


def test_lines_of_repeated_rows_are_kept_once(spark):
    text = "a line that stands in two rows\n\nand another one of them"
    rows = [(7, text, "x"), (7, text, "y"), (None, "something else that nobody says", "x"), (None, "something else that nobody says", "x"), (9, text.split("\n")[0], "z"), (8, None, "x"), (8, None, "x"), (10, "alone", "x")]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, line_root string")).collect()), key=repr)
    assert got == sorted([(7, text, 2, 0), (7, "", 2, 2), (None, "something else that nobody says", 1, 0), (None, "", 1, 1), (9, "", 1, 1), (8, None, 0, 0), (8, None, 0, 0), (10, "alone", 1, 0)], key=repr)
