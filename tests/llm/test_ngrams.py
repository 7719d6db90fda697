"""N-gram scoring and its Elias-Fano levels against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoframe.llm import ngrams, queries
from ethoframe.llm.elias_fano import EliasFano, read, write

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
END = None
ODD = [(None, None), (None, "of null id"), (900, None), (901, ""), (902, " \n\t "), (903, "Same SAME same " * 400), (904, "é É ß SS \x1c x"), (905, "unseen " * 3), (906, "repeated row"), (906, "repeated row"), (907, "long " * 50000)]


def brute_scores(rows, discount=0.75, steps=None):
    """[(held_out, n_tokens, n_known, train_tokens, base, score)] of (doc_id, text) rows; steps: quantise logarithms as the model does."""
    q = (lambda p: p) if steps is None else (lambda p: 10 ** (-np.rint(-np.log10(p) * steps) / steps))
    texts = [([*SPACED.findall(brute.lower(t)), END], zlib.crc32(str("" if d is None else d).encode()) % 7 == 2) for d, t in rows]
    one, two, three, after_pair, context = Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    for tokens, held in texts:
        if not held:
            one.update(tokens)
            line = [END, *tokens]
            two.update(zip(line, line[1:], strict=False))
            three.update(zip(line, line[1:], line[2:], strict=False))
    for (u, v), n in two.items():
        context[u,].add(v)
    for (u, v, w), n in three.items():
        context[u, v].add(w)
        after_pair[u, v] += n
    total, words = sum(one.values()), len(one)
    out = []
    for tokens, held in texts:
        base = score = 0.0
        line = [END, *tokens]
        for i, w in enumerate(tokens):
            p = (one[w] + 1) / (total + words + 1)
            base += math.log10(p)
            v = line[i]
            if one[v]:
                n = two[v, w]
                p = (q((n - discount) / one[v]) if n else 0) + q(discount * len(context[v,]) / one[v]) * p
            if i and after_pair[line[i - 1], v]:
                pair = line[i - 1], v
                n = three[*pair, w]
                p = (q((n - discount) / after_pair[pair]) if n else 0) + q(discount * len(context[pair]) / after_pair[pair]) * p
            score += math.log10(p)
        out.append((held, len(tokens), sum(one[w] > 0 for w in tokens), total, base, score))
    return out


def check(got, rows, places):
    want = Counter((d, t, *w[:4], round(w[4], 6), round(w[5], places)) for (d, t), w in zip(rows, brute_scores(rows, steps=ngrams.STEPS), strict=True))
    assert Counter((r.doc_id, r.text, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, places)) for r in got) == want


def test_scores(spark, documents):
    rows = [(d, t) for d, t, *_ in documents] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("clash"))
    check(ngrams.score_documents(docs).collect(), rows, 6)


@pytest.mark.parametrize("shard_tokens", [1000, 60])
def test_many_shards(spark, documents, shard_tokens):
    """Words and pairs that lie in several shards have their totals from all of them."""
    rows = [(d, t) for d, t, *_ in documents] + [(1000 + i, f"hot pair {'abcdefghij'[i % 10]}{i % 37} end hot pair x{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = ngrams.train(docs.where(~ngrams.held_out(F.col("doc_id"))), shard_tokens=shard_tokens)
    got = {(r.doc_id, r.text): r for r in ngrams.score_texts(docs, model).collect()}
    assert len(model.shards) > 3
    for (d, t), (_, n, known, total, base, score) in zip(rows, brute_scores(rows), strict=True):
        r = got[d, t]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base) and abs(r.score - score) <= 4e-4 * n


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b d") for i in range(40)] + [(50, "b c"), (51, "c c c d a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngrams.train(docs)
    for context in ("", "a", "a b", "d", "z", "z z", "c c"):
        texts = spark.createDataFrame([(i, f"{context} {w}".strip()) for i, w in enumerate(["a", "b", "c", "d", "unknown"])] + [(9, context)], "doc_id long, text string")
        h = {r.doc_id: r.text for r in texts.collect()}
        import pyarrow as pa

        n = len(context.split())
        tokens, starts = ngrams.text_tokens(pa.array([h[i] for i in range(5)] + [context]))
        p = model.probabilities(tokens, starts)[1]
        following = [p[starts[i] + n] for i in range(5)] + [p[starts[5] + n]]
        assert sum(following) == pytest.approx(1, abs=2e-3)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngrams.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = ngrams.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 5), (1000, 1000), (1000, 10**5), (20000, 1 << 62), (3, 1 << 62), (30000, 1 << 31)])
def test_elias_fano(tmp_path, n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    write(str(tmp_path / "x"), [*EliasFano.of(values, universe).parts(), np.arange(5, dtype=np.uint16)])
    parts = read(str(tmp_path / "x"))
    sequence = EliasFano.from_parts(parts[:5])
    assert parts[5].tolist() == [0, 1, 2, 3, 4] and (sequence.values(np.arange(n)) == values).all()
    first = {}
    for i, x in enumerate(values.tolist()):
        first.setdefault(x, i)
    asked = np.concatenate([values, rng.integers(0, universe, 500), [0, universe - 1]])
    assert sequence.find(asked).tolist() == [first.get(x, -1) for x in asked.tolist()]


def test_a_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op11_lm_scoring(spark, sf).collect()}
    for (d, _), w in zip(rows, brute_scores(rows, steps=ngrams.STEPS), strict=True):
        assert (got[d].held_out, got[d].n_tokens, got[d].n_known, got[d].train_tokens) == w[:4] and got[d].base_score == pytest.approx(w[4], abs=1e-5) and got[d].score == pytest.approx(w[5], abs=1e-5)
