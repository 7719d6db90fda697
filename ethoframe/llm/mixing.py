"""Mixing sources to target weights by entropy balancing.

Every document gets a rate of exponential form, r = min(cap, exp(lambda_s * size / mean size)), where lambda_s solves the convex dual of
the token constraint of its source: the sum of r * size over the source equals the source's target. Newton's method runs on all sources at
once; each step is one distributed sum over (source, size, documents) counts, which are far fewer than documents. Rates are then
rounded into whole copies by error diffusion over bounded buckets of documents, largest first, so that a bucket misses its share by no
more than a small document.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3 ...; all targets together are the total size; a target above
``cap`` times its source's size stops there, and what is over is shared again by weight until none is above.

Nulls and edges: a null text has size 0 and takes nothing; a null source is a source of its own; an empty table gives an empty result;
equal sizes share one rate; repeated rows are separate documents (their ids tie, their copies may differ). Other columns pass through.
The per-source table goes to the driver: it has a row per distinct source, not per document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.llm.common import SPACE_SEPARATORS, broadcast_up_to, materialize, words_of

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
#: Documents of one bucket of the rounding, on average.
BUCKET_DOCS = 2_000
NEWTON_STEPS = 60


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Water filling: the shares of the sources at their cap are fixed, the others split the rest by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        unit = left / w if (w := sum(weight[s] for s in free)) else 0.0
        above = {s for s in free if weight[s] * unit > cap * sizes[s]}
        if not above:
            return {s: float(cap * sizes[s]) if s in capped else weight[s] * unit for s in order}
        capped |= above


def _key(source: Column) -> Column:
    """A join key that keeps a null source apart from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _solve(counts: DataFrame, goal: dict[str, float], size: dict[str, int], docs: dict[str, int], cap: float) -> dict[str, float]:
    """Newton steps on the dual of every source, kept inside a bracket that each step narrows."""
    spark, state = counts.sparkSession, {}
    for k in goal:
        if size[k] <= 0:
            state[k] = (0.0, 0.0, 0.0, True)
        elif goal[k] >= cap * size[k] * (1 - 1e-12):
            state[k] = (math.inf, 0.0, 0.0, True)
        else:
            state[k] = (0.0, -math.inf, math.inf, False)
    for _ in range(NEWTON_STEPS):
        open_ = [k for k, s in state.items() if not s[3]]
        if not open_:
            break
        at = spark.createDataFrame([(k, state[k][0], size[k] / docs[k]) for k in open_], "key string, lam double, mean double")
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        mass = F.col("n") * F.col("size")
        sums = counts.join(broadcast_up_to(at, len(open_)), "key").groupBy("key").agg(
            F.sum(F.least(rate, F.lit(float(cap))) * mass).alias("got"), F.sum(F.when(rate < cap, rate * z * mass).otherwise(0.0)).alias("slope")
        )
        for key, got, slope in sums.collect():
            lam, lo, hi, _ = state[key]
            gap = got - goal[key]
            if abs(gap) <= 1e-9 * max(1.0, goal[key]):
                state[key] = (lam, lo, hi, True)
                continue
            lo, hi = (lam, hi) if gap < 0 else (lo, lam)
            step = lam - gap / slope if slope > 0 else math.nan
            if not lo < step < hi:
                step = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else (2 * lam + 1 if gap < 0 else 2 * lam - 1)
            state[key] = (step, lo, hi, math.isfinite(lo) and math.isfinite(hi) and hi - lo < 1e-13 * max(1.0, abs(lam)))
    return {k: s[0] for k, s in state.items()}


def _round_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies, largest documents first; the words that a document misses or exceeds are carried on to the next ones."""
    pdf = pdf.sort_values(["size", "id_hash", "mix_doc"], ascending=[False, True, True], kind="stable")
    carry, copies = 0.0, []
    for rate, size, rows, cap in zip(pdf["rate"], pdf["size"], pdf["rows"], pdf["cap"], strict=True):
        mass = size * rows
        want = rate * mass + carry
        c = min(int(cap), max(0, math.floor(want / mass + 0.5))) if mass else 1
        carry = want - c * mass
        copies.append(c)
    return pdf[["mix_doc", "mix_key", "size"]].assign(copies=copies)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken (= copies * size); input columns of these names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "taken", "mix_key", "mix_doc")
    sized = docs.withColumns({
        "size": F.size(words_of(F.col("text"), SPACE_SEPARATORS)).cast("long"),
        "mix_key": _key(F.col("source")), "mix_doc": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
    })
    light = materialize(sized.groupBy("mix_doc", "source", "mix_key", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    counts = materialize(light.groupBy("mix_key", "size").agg(F.sum("rows").alias("n"), F.first("source").alias("source")).withColumnRenamed("mix_key", "key"), "mix-counts")
    per_source = counts.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("docs")).collect()
    size, n_docs = {r["key"]: int(r["size"]) for r in per_source}, {r["key"]: int(r["docs"]) for r in per_source}
    by_name = targets({r["source"]: int(r["size"]) for r in per_source}, weights, cap)
    goal = {r["key"]: by_name[r["source"]] for r in per_source}
    lam = _solve(counts, goal, size, n_docs, float(cap))
    plan = spark.createDataFrame(
        [(k, size[k], goal[k], lam[k] if math.isfinite(lam[k]) else None, (size[k] / n_docs[k]) or 1.0, max(1, -(-n_docs[k] // BUCKET_DOCS))) for k in size],
        "mix_key string, source_size long, target double, lam double, mean_size double, buckets int",
    )
    plan = broadcast_up_to(plan, len(size))
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean_size"), F.lit(50.0)))
    rate = F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))
    rated = light.join(plan, "mix_key").withColumns({"rate": rate, "cap": F.lit(cap), "id_hash": F.xxhash64("mix_doc")})
    rated = rated.withColumn("bucket", F.pmod("id_hash", "buckets")).select("mix_doc", "mix_key", "size", "rows", "rate", "cap", "id_hash", "bucket")
    copies = rated.groupBy("mix_key", "bucket").applyInPandas(_round_bucket, "mix_doc string, mix_key string, size long, copies long")
    out = sized.join(plan, "mix_key").join(copies, ["mix_doc", "mix_key", "size"])
    return out.withColumn("rate", rate).withColumn("taken", F.col("copies") * F.col("size")).drop("mix_key", "mix_doc", "lam", "mean_size", "buckets")
