"""Queries on runs, bouts and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoframe.operators import bouts, patterns, runs
from ethoframe.plans.inputs import BOUTS, E, FRAME, IDS, LABELS, RUNS, event_bouts, event_runs, events, r6, sql, table
from ethoframe.plans.registry import query


@query(
    sql(
        BOUTS,
        """SELECT p.user_id, p.behavior_name AS previous_behavior, n.behavior_name AS next_behavior, count(*) AS transition_count
        FROM b p JOIN b n ON p.user_id = n.user_id AND n.frame_index = p.end_frame + 1 GROUP BY ALL""",
    )
)
def transition_counts(spark, sf_dir):
    found = bouts.transitions(event_bouts(spark, sf_dir), IDS)
    return found.where("transition_count > 0")


@query(sql(RUNS, "SELECT * FROM runs"))
def rle_series(spark, sf_dir):
    return event_runs(spark, sf_dir)


@query(sql(E, "SELECT user_id, frame_index AS \"index\", event_type AS run_value FROM e"))
def expand_rle_df_to_series(spark, sf_dir):
    return runs.expand_runs(event_runs(spark, sf_dir)).select("user_id", "index", "run_value")


@query(sql(RUNS, "SELECT user_id, start_index AS index_start, end_index AS index_end, run_value AS value, run_length AS length FROM runs"))
def series_to_value_chunks(spark, sf_dir):
    return runs.value_chunks(events(spark, sf_dir), "event_type", IDS).drop("grouped_index")


@query(sql(E, "SELECT user_id, frame_index AS \"index\", event_type AS value FROM e"))
def value_chunks_to_series(spark, sf_dir):
    return runs.chunks_to_series(runs.value_chunks(events(spark, sf_dir), "event_type", IDS)).select("user_id", "index", "value")


@query("SELECT o_orderkey, CAST(unnest(range(o_orderkey, o_orderkey + o_custkey % 5)) AS BIGINT) AS \"index\" FROM orders")
def expand_index_from_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + F.pmod("o_custkey", F.lit(5))).alias("e"))
    return runs.expand_limits(rows, "s", "e", inclusive=False)


@query(sql(E, "SELECT user_id, frame_index, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_index) AS BIGINT) AS segment FROM e"))
def split_pd_with_boolean_series(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("flag", F.col("event_type") == "error")
    return runs.segment_ids(rows, "flag", IDS).select("user_id", FRAME, "segment")


@query(
    sql(
        E,
        """, c AS (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame_index) AS k FROM e)
        SELECT user_id, frame_index, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY frame_index) AS BIGINT) AS consecutive FROM c""",
    )
)
def consecutive_boolean_counter(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("flag", F.col("value") > 20)
    return runs.consecutive_true(rows, "flag", IDS).select("user_id", FRAME, "consecutive")


@query(
    sql(
        E,
        """, l AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index))
        SELECT user_id, frame_index, value FROM l WHERE coalesce(value > p, false) OR coalesce(n > value, false)""",
    )
)
def pd_transitions_on_column(spark, sf_dir):
    return runs.rising_pairs(events(spark, sf_dir), "value", IDS).select("user_id", FRAME, "value")


@query(
    sql(
        RUNS,
        """, o AS (SELECT user_id, start_index, run_value, row_number() OVER (PARTITION BY run_value ORDER BY user_id, start_index) - 1 AS occurrence_id FROM runs)
        SELECT g.user_id, g.frame_index, g.event_type, g.frame_index = o.start_index AS onset, CAST(g.frame_index - o.start_index AS BIGINT) AS label_frame, CAST(o.occurrence_id AS BIGINT) AS occurrence_id
        FROM g JOIN runs r ON g.user_id = r.user_id AND g.frame_index BETWEEN r.start_index AND r.end_index
        JOIN o ON o.user_id = r.user_id AND o.start_index = r.start_index""",
    )
)
def compute_syllable_moseq_df(spark, sf_dir):
    return runs.onset_counters(events(spark, sf_dir).select("user_id", FRAME, "event_type"), "event_type", IDS)


@query(
    """WITH g AS (SELECT *, sum(CASE WHEN role IS NOT DISTINCT FROM before AND f > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run
      FROM (SELECT conv_id, turn, role, lag(role) OVER w AS before, row_number() OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))
    SELECT conv_id, min(turn) AS frame_index, max(turn) AS end_frame, CAST(max(turn) - min(turn) + 1 AS BIGINT) AS bout_length, any_value(role) AS behavior_name
    FROM g WHERE role IS NOT NULL GROUP BY conv_id, run"""
)
def behavior_to_bout_df(spark, sf_dir):
    return bouts.label_bouts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "role", ["conv_id"], "turn")


@query(
    """WITH u AS (SELECT 0 AS series, doc_id, 'quality' AS behavior_name, quality = 1 AS on_ FROM labels UNION ALL SELECT 0, doc_id, 'toxic', toxic = 1 FROM labels),
    g AS (SELECT *, sum(CASE WHEN on_ IS NOT DISTINCT FROM before AND f > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY behavior_name ORDER BY doc_id) AS run
      FROM (SELECT *, lag(on_) OVER w AS before, row_number() OVER w AS f FROM u WINDOW w AS (PARTITION BY behavior_name ORDER BY doc_id)))
    SELECT behavior_name, min(doc_id) AS frame_index, max(doc_id) AS end_frame, CAST(max(doc_id) - min(doc_id) + 1 AS BIGINT) AS bout_length
    FROM g GROUP BY behavior_name, run HAVING bool_and(on_)"""
)
def multi_label_bouts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return bouts.boolean_bouts(rows, ["quality", "toxic"], [], "doc_id").select("behavior_name", FRAME, "end_frame", "bout_length")


@query(sql(E, "SELECT user_id, frame_index, " + ", ".join(f"event_type = '{b}' AS {b}" for b in LABELS) + " FROM e"))
def bout_to_behavior_df(spark, sf_dir):
    return bouts.bouts_to_behaviour(event_bouts(spark, sf_dir), LABELS, IDS)


@query(sql(BOUTS, "SELECT user_id, behavior_name, count(*) AS n FROM b GROUP BY ALL"))
def bout_df_to_count_series(spark, sf_dir):
    return bouts.bout_counts(event_bouts(spark, sf_dir), IDS)


@query(sql(BOUTS, "SELECT user_id, behavior_name, CAST(sum(bout_length) AS BIGINT) AS n FROM b GROUP BY ALL"))
def bout_frame_counts(spark, sf_dir):
    return bouts.bout_counts(event_bouts(spark, sf_dir), IDS, by_length=True)


@query(sql(BOUTS, ", c AS (SELECT user_id, behavior_name, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, behavior_name, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS proportion FROM c"))
def bout_df_to_proportion_series(spark, sf_dir):
    found = bouts.proportions(bouts.bout_counts(event_bouts(spark, sf_dir), IDS), IDS)
    return found.select("user_id", "behavior_name", r6("proportion").alias("proportion"))


@query(sql(BOUTS, "SELECT behavior_name, round(count(*) / (SELECT count(*) FROM b), 6) AS proportion FROM b GROUP BY ALL"))
def count_to_proportion_series(spark, sf_dir):
    found = bouts.proportions(bouts.bout_counts(event_bouts(spark, sf_dir), IDS), IDS, combine=True)
    return found.select("behavior_name", r6("proportion").alias("proportion"))


_MOVES = """, m AS (SELECT p.user_id, p.behavior_name AS a, n.behavior_name AS z, count(*) AS k FROM b p JOIN b n ON p.user_id = n.user_id AND n.frame_index = p.end_frame + 1 GROUP BY ALL)"""


@query(
    sql(
        BOUTS,
        _MOVES
        + """, l AS (SELECT DISTINCT behavior_name FROM b)
        SELECT x.behavior_name AS previous_behavior, y.behavior_name AS next_behavior, CAST(coalesce(sum(k), 0) AS BIGINT) AS transition_count
        FROM l x CROSS JOIN l y LEFT JOIN m ON m.a = x.behavior_name AND m.z = y.behavior_name GROUP BY ALL""",
    )
)
def bout_df_to_transition_series(spark, sf_dir):
    return bouts.transitions(event_bouts(spark, sf_dir), IDS, per_id=False)


_CELLS = [f"{a}->{b}" for a in LABELS for b in LABELS]
_WIDE = (
    _MOVES
    + ", w AS (SELECT u.user_id, "
    + ", ".join(f"CAST(coalesce(sum(k) FILTER (WHERE a = '{c.split('->')[0]}' AND z = '{c.split('->')[1]}'), 0) AS BIGINT) AS \"{c}\"" for c in _CELLS)
    + " FROM (SELECT DISTINCT user_id FROM b) u LEFT JOIN m ON m.user_id = u.user_id GROUP BY u.user_id), c AS (SELECT user_id, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE behavior_name = '{b}') AS BIGINT) AS {b}" for b in LABELS)
    + " FROM b GROUP BY user_id)"
)


@query(sql(BOUTS, _WIDE + " SELECT * FROM w JOIN c USING (user_id)"))
def bout_to_vector_df(spark, sf_dir):
    return bouts.behaviour_vectors(event_bouts(spark, sf_dir), LABELS, IDS)


_TOTAL = "(" + " + ".join(f'"{c}"' for c in _CELLS) + ")"


@query(sql(BOUTS, _WIDE + " SELECT user_id, " + ", ".join(f'round("{c}" / nullif({_TOTAL}, 0), 6) AS "{c}"' for c in _CELLS) + ", " + ", ".join(LABELS) + " FROM w JOIN c USING (user_id)"))
def post_process_vector_df(spark, sf_dir):
    vectors = bouts.normalised_vectors(bouts.behaviour_vectors(event_bouts(spark, sf_dir), LABELS, IDS), LABELS, IDS)
    return vectors.select("user_id", *(r6(F.col(f"`{c}`")).alias(c) for c in _CELLS), *LABELS)


_NEXT = ", n AS (SELECT user_id, run_value AS g0, lead(run_value) OVER w AS g1, lead(run_value, 2) OVER w AS g2 FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY start_index)), k AS (SELECT g0, g1, count(*) AS n FROM n WHERE g0 IS NOT NULL AND g1 IS NOT NULL GROUP BY ALL)"


def _bigrams(spark, sf_dir):
    return patterns.ngram_counts(events(spark, sf_dir), "event_type", IDS)


@query(sql(RUNS, _NEXT + " SELECT g0, g1, n FROM k"))
def n_gram_syllable_transition_series(spark, sf_dir):
    return _bigrams(spark, sf_dir)


@query(sql(RUNS, _NEXT + " SELECT g0, g1, g2, count(*) AS n FROM n WHERE g0 IS NOT NULL AND g1 IS NOT NULL AND g2 IS NOT NULL GROUP BY ALL"))
def trigram_counts(spark, sf_dir):
    return patterns.ngram_counts(events(spark, sf_dir), "event_type", IDS, n=3)


@query(sql(RUNS, _NEXT + " SELECT g0, g1, n, round(n / sum(n) OVER (), 6) AS share FROM k"))
def get_syllable_transition_series(spark, sf_dir):
    return patterns.normalise_ngrams(_bigrams(spark, sf_dir), "bigram").withColumn("share", r6("share"))


@query(sql(RUNS, _NEXT + " SELECT g0, g1, n, round(n / sum(n) OVER (PARTITION BY g0), 6) AS share FROM k"))
def normalize_rows(spark, sf_dir):
    return patterns.normalise_ngrams(_bigrams(spark, sf_dir), "rows").withColumn("share", r6("share"))


@query(sql(RUNS, _NEXT + " SELECT g0, g1, n, round(n / sum(n) OVER (PARTITION BY g1), 6) AS share FROM k"))
def normalize_columns(spark, sf_dir):
    return patterns.normalise_ngrams(_bigrams(spark, sf_dir), "columns").withColumn("share", r6("share"))


@query(sql(RUNS, _NEXT + " SELECT x.g0, x.g1, CASE WHEN x.n > coalesce(y.n, 0) THEN x.n ELSE 0 END AS n FROM k x LEFT JOIN k y ON x.g0 = y.g1 AND x.g1 = y.g0"))
def trim_syllable_transition_frame_to_monodirectional(spark, sf_dir):
    return patterns.stronger_direction(_bigrams(spark, sf_dir))


@query(sql(RUNS, _NEXT + " SELECT g0, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE g1 = '{b}'), 0) AS BIGINT) AS {b}" for b in LABELS) + " FROM k GROUP BY g0"))
def syllable_transition_series_to_frame(spark, sf_dir):
    return patterns.transition_matrix(_bigrams(spark, sf_dir), LABELS)


@query(sql(RUNS, ", c AS (SELECT run_value AS event_type, count(*) AS n FROM runs WHERE run_value IS NOT NULL GROUP BY ALL) SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM c"))
def get_syllable_frequencies(spark, sf_dir):
    return patterns.label_frequencies(events(spark, sf_dir), "event_type", IDS).withColumn("share", r6("share"))


@query(sql(RUNS, "SELECT user_id, run_value AS event_type, run_length AS duration FROM runs"))
def get_syllable_durations(spark, sf_dir):
    return patterns.run_durations(events(spark, sf_dir), "event_type", IDS)


@query(
    sql(
        RUNS,
        """, s AS (SELECT user_id, event_type, count(value) AS value_count, avg(value) AS value_mean, stddev_samp(value) AS value_std, min(value) AS value_min,
             quantile_cont(value, 0.25) AS value_p25, quantile_cont(value, 0.5) AS value_p50, quantile_cont(value, 0.75) AS value_p75, max(value) AS value_max FROM e GROUP BY ALL),
        d AS (SELECT user_id, run_value AS event_type, count(*) AS duration_count, avg(run_length / 30.0) AS duration_mean, max(run_length / 30.0) AS duration_max FROM runs GROUP BY ALL),
        f AS (SELECT user_id, event_type, duration_count / sum(duration_count) OVER (PARTITION BY user_id) AS share FROM d)
        SELECT user_id, event_type, value_count, round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std, value_min, round(value_p25, 6) AS value_p25, round(value_p50, 6) AS value_p50,
               round(value_p75, 6) AS value_p75, value_max, duration_count, round(duration_mean, 6) AS duration_mean, round(duration_max, 6) AS duration_max, round(share, 6) AS share
        FROM s JOIN d USING (user_id, event_type) JOIN f USING (user_id, event_type)""",
    )
)
def compute_syllable_stats_df(spark, sf_dir):
    stats = patterns.label_statistics(events(spark, sf_dir), "event_type", ["value"], IDS, by=IDS)
    rounded = ["value_mean", "value_std", "value_p25", "value_p50", "value_p75", "duration_mean", "duration_max", "share"]
    names = ["user_id", "event_type", "value_count", "value_mean", "value_std", "value_min", "value_p25", "value_p50", "value_p75", "value_max", "duration_count", "duration_mean", "duration_max", "share"]
    return stats.select(*(r6(c).alias(c) if c in rounded else F.col(c) for c in names))


@query(
    sql(
        E,
        """, p AS (SELECT CAST(k AS INTEGER) AS lag, event_type AS a, lag(CASE WHEN value > 20 THEN 'high' ELSE 'low' END, CAST(k AS INTEGER)) OVER (PARTITION BY k, user_id ORDER BY frame_index) AS b
             FROM e CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)),
        c AS (SELECT lag, a, b, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
        SELECT lag, a, b, n, round(n / sum(n) OVER (PARTITION BY lag), 6) AS share FROM c""",
    )
)
def get_lag_occurrence_matrix_dict(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("level", F.when(F.col("value") > 20, "high").otherwise("low"))
    return patterns.lag_occurrences(rows, "event_type", "level", IDS, most=3).withColumn("share", r6("share"))


@query(
    sql(
        E,
        """, l AS (SELECT event_type AS a, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS b FROM e),
        x AS (SELECT a, count(*) / (SELECT count(*) FROM l) AS p FROM l GROUP BY a), y AS (SELECT b, count(*) / (SELECT count(*) FROM l) AS q FROM l GROUP BY b)
        SELECT a, b, round(p * q, 6) AS share FROM x CROSS JOIN y""",
    )
)
def get_independent_joint_probability_matrix(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("level", F.when(F.col("value") > 20, "high").otherwise("low"))
    return patterns.independent_joint(rows, "event_type", "level").withColumn("share", r6("share"))


@query(
    sql(
        E,
        """, s AS (SELECT user_id, frame_index, event_type AS s0, lead(event_type) OVER w AS s1, lead(event_type, 2) OVER w AS s2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index))
        SELECT user_id, frame_index, (s0 = 'view' AND s1 = 'click' AND s2 = 'error') AS occurs FROM s WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL""",
    )
)
def get_sequence_occurrence_series(spark, sf_dir):
    return patterns.sequence_occurrences(events(spark, sf_dir), "event_type", [["view", "click", "error"]], IDS).select("user_id", FRAME, "occurs")


@query(
    sql(
        RUNS,
        """, n AS (SELECT *, run_value = 'view' AND lead(run_value) OVER w = 'click' AS here, lag(run_value) OVER w = 'view' AND run_value = 'click' AS there FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY start_index))
        SELECT e.user_id, e.frame_index, e.event_type, coalesce(here, false) OR coalesce(there, false) AS in_pattern FROM e JOIN n ON e.user_id = n.user_id AND e.frame_index BETWEEN n.start_index AND n.end_index""",
    )
)
def get_pattern_occurrence_series(spark, sf_dir):
    return patterns.pattern_frames(events(spark, sf_dir), "event_type", [["view", "click"]], IDS)


_FUZZY = """, n AS (SELECT user_id, start_index, run_value AS a, lead(run_value) OVER w AS b, lead(run_value, 2) OVER w AS c, lead(end_index, 2) OVER w AS last, row_number() OVER w - 1 AS pos
    FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY start_index)),
  m AS (SELECT *, (a <> 'view')::INT + (b <> 'click')::INT + (c <> 'error')::INT AS wrong FROM n WHERE c IS NOT NULL)"""


@query(sql(RUNS, _FUZZY + " SELECT user_id, CAST(pos AS INTEGER) AS match_start, CAST(wrong AS INTEGER) AS n_mismatches, start_index AS sequence_index_start, last AS sequence_index_end FROM m WHERE wrong <= 1"))
def get_pattern_match_df(spark, sf_dir):
    wanted = spark.createDataFrame([(["view", "click", "error"],)], "pattern array<string>")
    found = patterns.pattern_matches(patterns.run_sequences(events(spark, sf_dir), "event_type", IDS), wanted, IDS, most=1)
    return found.select("user_id", "match_start", "n_mismatches", "sequence_index_start", "sequence_index_end")


@query(sql(RUNS, _FUZZY + ", x AS (SELECT a || '>' || b || '>' || c AS pattern, count(*) AS n FROM m GROUP BY ALL) SELECT pattern, n, round(n / (SELECT count(DISTINCT user_id) FROM runs), 6) AS per_sequence FROM x"))
def match_df_to_counts_df(spark, sf_dir):
    sequences = patterns.run_sequences(events(spark, sf_dir), "event_type", IDS)
    found = patterns.pattern_matches(sequences, patterns.window_patterns(sequences, 3), IDS)
    n = sequences.count()
    return patterns.match_counts(found, n).select(F.array_join("pattern", ">").alias("pattern"), "n", r6("per_sequence").alias("per_sequence"))


@query(sql(RUNS, _FUZZY + " SELECT DISTINCT user_id, CAST(unnest(range(start_index, last + 1)) AS BIGINT) AS frame_index FROM m WHERE wrong = 0"))
def match_df_to_occurrence_df(spark, sf_dir):
    wanted = spark.createDataFrame([(["view", "click", "error"],)], "pattern array<string>")
    return patterns.match_occurrences(patterns.pattern_matches(patterns.run_sequences(events(spark, sf_dir), "event_type", IDS), wanted, IDS), IDS)


@query(sql(RUNS, "SELECT user_id, min(start_index) AS first_index, CAST(count(*) AS INTEGER) AS n_runs, string_agg(run_value, '>' ORDER BY start_index) AS sequence FROM runs GROUP BY user_id"))
def syllable_series_to_sequence(spark, sf_dir):
    s = patterns.run_sequences(events(spark, sf_dir), "event_type", IDS)
    return s.select("user_id", F.array_min("starts").alias("first_index"), F.size("run_values").alias("n_runs"), F.array_join("run_values", ">").alias("sequence"))


@query()
def simplify_numeric_value_chunks(spark, sf_dir):
    """A fold with a moving mean: checked against plain Python in the tests."""
    rows = events(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 10).cast("double"))
    return runs.merge_chunks(runs.run_length_encode(rows, "level", IDS), IDS, tolerance=1.0)
