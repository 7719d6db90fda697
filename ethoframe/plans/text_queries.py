"""Queries on text, filters, aggregates, sets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoframe.functions import arrays, columns, text
from ethoframe.operators import selection
from ethoframe.plans.inputs import E, FRAME, IDS, events, r6, sql, table
from ethoframe.plans.registry import query
from ethoframe.sources import files


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/(\w+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/(\w+)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/(\w+)', 3) AS lang FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/(\w+)')")
def build_regex_df(spark, sf_dir):
    return files.pattern_table(table(spark, sf_dir, "pages"), "url", r"^(https?)://([^/]+)/(\w+)", ["scheme", "host", "lang"]).select("page_id", "scheme", "host", "lang")


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '^(?:src1)') THEN 'one' WHEN regexp_matches(source, '^(?:src[2-5]$)') THEN 'few' WHEN regexp_matches(source, '^(?:src)') THEN 'other' END AS label FROM documents")
def label_series_from_regex_dict(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.first_label(F.col("source"), {"one": "src1", "few": "src[2-5]$", "other": "src"}).alias("label"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '', 'g'), '\d+', '#', 'g') AS url FROM pages")
def replace_regex_dict(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.replace_patterns(F.col("url"), {"^https?://": "", r"\d+": "#"}).alias("url"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, 'page=(\d+)') THEN regexp_extract(url, 'page=(\d+)', 1) ELSE 'none' END AS page FROM pages")
def regex_search_with_fallback_value(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.first_match(F.col("url"), r"page=(\d+)", 1, "none").alias("page"))


@query(r"SELECT p_partkey, regexp_replace(p_name || '#' || p_brand, '[^\p{L}\p{N}\._\- ]', '', 'g') AS name FROM part")
def make_string_alphanum(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.alphanumeric(F.concat("p_name", F.lit("#"), "p_brand")).alias("name"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS kind FROM events")
def pd_translate_by_dict(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.translate_values(F.col("event_type"), {"click": "c", "view": "v"}).alias("kind"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def pd_expand_dict_series(spark, sf_dir):
    return columns.expand_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k bigint")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND user_id = 7")
def pd_filter_df(spark, sf_dir):
    return selection.filter_equal(table(spark, sf_dir, "events"), {"event_type": "click", "user_id": 7}).select("event_id", "event_type", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type FROM events WHERE user_id = 7")
def pd_multi_filter_df(spark, sf_dir):
    return selection.filter_any(table(spark, sf_dir, "events"), [{"event_type": "click"}, {"user_id": 7}]).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click' AND user_id IS DISTINCT FROM 7")
def pd_remove_value_rows(spark, sf_dir):
    return columns.drop_values(table(spark, sf_dir, "events"), {"event_type": "click", "user_id": 7}).select("event_id")


@query(sql(E, "SELECT event_id, " + ", ".join(f"event_type = '{b}' AS {b}" for b in ("click", "error")) + " FROM e"))
def behavior_series_to_df(spark, sf_dir):
    return columns.one_hot(events(spark, sf_dir), "event_type", ["click", "error"], ["event_id"])


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS labels FROM labels")
def behavior_df_to_series(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return columns.labels_of(rows, ["quality", "toxic"]).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS BIGINT) AS combined_idx FROM orders")
def combine_multi_index_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return columns.key_numbers(rows, ["o_orderstatus", "o_orderpriority"])[0]


@query("SELECT event_id, CAST(trunc(value / 1000 * 30) AS BIGINT) AS frame, round(event_id / 30.0 * 1000, 6) AS msec FROM events")
def timestamp_to_frame(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", columns.frame_of(F.col("value"), 30.0).alias("frame"), r6(columns.msec_of(F.col("event_id"), 30.0)).alias("msec"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS duplications FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL")
def pd_count_duplications(spark, sf_dir):
    return selection.group_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, n, round(n / sum(n) OVER (), 6) AS density, round(sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cumulative FROM c")
def pd_categorical_histogram(spark, sf_dir):
    return selection.categorical_histogram(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", r6("density").alias("density"), r6("cumulative").alias("cumulative"))


@query(
    """WITH q AS (SELECT unnest(range(0, 21)) AS i), a AS (SELECT quantile_cont(value, list_transform(range(0, 21), lambda x: x / 20)) AS v FROM events WHERE event_type = 'click'), b AS (SELECT quantile_cont(value, list_transform(range(0, 21), lambda x: x / 20)) AS v FROM events WHERE event_type = 'view')
    SELECT round(i / 20, 6) AS q, round(a.v[i + 1], 6) AS sample_a, round(b.v[i + 1], 6) AS sample_b FROM q CROSS JOIN a CROSS JOIN b"""
)
def qq_plot(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    out = selection.quantile_pairs(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "value", 21)
    return out.select(r6("q").alias("q"), r6("sample_a").alias("sample_a"), r6("sample_b").alias("sample_b"))


@query("SELECT quality = 1 AS quality, toxic = 1 AS toxic, count(*) AS n FROM labels GROUP BY ALL")
def boolean_series_venn(spark, sf_dir):
    return selection.overlap_counts(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("SELECT c_custkey AS start, c_custkey + 5 AS stop, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_orderkey >= c_custkey AND o_orderkey < c_custkey + 5 GROUP BY ALL")
def pd_series_stat_in_limits(spark, sf_dir):
    limits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("start"), (F.col("c_custkey") + 5).alias("stop"))
    return selection.stats_in_limits(table(spark, sf_dir, "orders"), "o_totalprice", limits, "o_orderkey").withColumn("total", F.round("total", 2))


@query("SELECT o_orderpriority AS value, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS keys FROM orders GROUP BY o_orderpriority")
def invert_flat_dict(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("value"))
    return text.invert_pairs(rows, "o_orderstatus", "value").withColumn("keys", F.array_join("keys", ","))


@query("SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey <> n_regionkey UNION SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey <> n_regionkey")
def mirror_relationship_dict(spark, sf_dir):
    return text.mirror_pairs(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")), "a", "b")


@query("WITH s AS (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem), c AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY ALL) SELECT coalesce(max(n) <= 1, true) AS disjoint FROM c")
def check_disjoint_sets(spark, sf_dir):
    return selection.are_disjoint(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey")


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total, CAST(len(embedding) AS INTEGER) AS n, CAST(ceil(len(embedding) / 2) - 1 AS BIGINT) AS middle FROM embeddings")
def iter_cumsum(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", (F.round(F.element_at(arrays.running_sum(F.col("embedding")), -1), 5) + F.lit(0.0)).alias("total"), F.size("embedding").alias("n"), arrays.middle_index(F.size("embedding")).alias("middle"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, length(p_name), 3), lambda i: substr(p_name, i + 1, 3)), '|') AS parts FROM part WHERE length(p_name) > 0")
def split_chunks(spark, sf_dir):
    letters = F.filter(F.split("p_name", ""), lambda c: c != "")
    rows = table(spark, sf_dir, "part").where("p_name <> ''").select("p_partkey", letters.alias("letters"))
    return rows.select("p_partkey", F.array_join(F.transform(arrays.chunks(F.col("letters"), 3), lambda c: F.array_join(c, "")), "|").alias("parts"))


@query("SELECT l_returnflag, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 9) AS mse FROM lineitem GROUP BY ALL")
def np_mse(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.pow(F.col("l_tax") - F.col("l_discount"), 2)), 9).alias("mse"))


@query("SELECT event_id, round_even(value / 5, 0) * 5 AS nearest FROM events")
def round_to_nearest_multiple(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.nearest_multiple(F.col("value"), F.lit(5)).alias("nearest"))


@query()
def pd_split_subsets(spark, sf_dir):
    """Parts by seeded hash; tests check sizes and disjointness."""
    return selection.split_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 4, by=["o_orderstatus"])


@query()
def pd_split_share(spark, sf_dir):
    return selection.split_sharing(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 3, share=0.3)


@query()
def get_sampled_trajectory_df(spark, sf_dir):
    rows = events(spark, sf_dir)
    return selection.sampled_trajectories(rows.select("user_id", FRAME, "event_type"), rows.select("user_id", FRAME, "x", "y"), "event_type", IDS, n=20, before=2, after=3)


@query()
def unified_sets(spark, sf_dir):
    """Orders that share a part, over all of lineitem; tests check it against union-find."""
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return selection.joined_sets(members, "l_orderkey", "l_partkey")
