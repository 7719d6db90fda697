"""Benchmark decontamination by a positional inverted index.

Test items are cut into windows of ``width`` consecutive words (a shorter item is one window). The index stores postings of training tokens: for
each token that is the rarest of some window, every place where it stands, with the words within ``width - 1`` of it. A window's
candidates are the offset-adjusted places of its rarest token; the other tokens' lists are intersected inside the posting, whose words around the place
are all that the window can cover. Matches are exact phrases (the same words in the same order) and, on request, proximity
matches (at least ``near`` of the window's distinct words within the posting's words).

Token frequencies are counted over all documents. Postings are linear in the text: a token is indexed once per place, never paired.

Nulls and edges: a null text has no words and no windows; windows that items share count for each of them; repeated documents and rows
each match; rows are known by doc_id and a hash of the text (mark), so rows that share a doc_id, or have none, are judged each by its own text; empty tables give no matches; extra columns are
ignored. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.llm.common import TEXT_SEPARATORS, ascii_lower, broadcast_up_to, materialize, words_of

WIDTH = 10


def tokens(text: Column) -> Column:
    return words_of(ascii_lower(text), TEXT_SEPARATORS)


def windows_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id and window (array of words), distinct."""
    rows = items.select("item_id", tokens(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    cut = F.when(F.size("words") > 0, F.transform(starts, lambda s: F.slice("words", s + 1, width)))
    return rows.select("item_id", F.explode(cut).alias("window")).distinct()


def build_index(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(postings, anchors): anchors are the windows with their rarest token and its offset."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), tokens(F.col("text")).alias("words"))
    spread = windows.select("item_id", "window", F.posexplode("window").alias("offset", "term"))
    vocabulary = materialize(spread.select("term").distinct(), "decon-terms")
    # explode_outer: with explode the optimizer would split texts a second time to test for empty arrays
    used = texts.select(F.explode_outer("words").alias("term"))
    counted = used.join(broadcast_up_to(vocabulary, vocabulary.count()), "term").groupBy("term").agg(F.count("*").alias("n"))
    frequency = materialize(counted, "decon-frequency")
    rarest = spread.join(frequency, "term", "left").groupBy("item_id", "window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).alias("rare")
    )
    # a window with a word that no document has cannot occur
    anchors = materialize(rarest.where("rare.n > 0").select("item_id", "window", F.col("rare.term").alias("term"), F.col("rare.offset").alias("offset")), "decon-anchors")
    terms = materialize(anchors.select("term").distinct(), "decon-rarest")
    places = texts.select("doc_id", "mark", "words", F.posexplode_outer("words").alias("pos", "term"))
    lead = F.least(F.col("pos"), F.lit(width - 1))
    postings = places.join(broadcast_up_to(terms, terms.count()), "term").select(
        "term", "doc_id", "mark", "pos", lead.alias("lead"), F.slice("words", F.col("pos") - lead + 1, lead + width).alias("around")
    )
    return materialize(postings, "decon-postings"), anchors


def match_windows(postings: DataFrame, anchors: DataFrame, near: float | None = None) -> DataFrame:
    """doc_id, mark, item_id, start, length, match (phrase or proximity): the windows' places. Proximity places start at the rarest token."""
    joined = postings.join(broadcast_up_to(anchors, anchors.count()), "term")
    length = F.size("window")
    exact = (F.col("lead") >= F.col("offset")) & (F.slice("around", F.col("lead") - F.col("offset") + 1, length) == F.col("window"))
    if near is None:
        return joined.where(exact).select("doc_id", "mark", "item_id", (F.col("pos") - F.col("offset")).alias("start"), length.alias("length"), F.lit("phrase").alias("match"))
    share = F.size(F.array_intersect("around", "window")) / F.size(F.array_distinct("window"))
    kind = F.when(exact, "phrase").when(share >= near, "proximity")
    start = F.when(exact, F.col("pos") - F.col("offset")).otherwise(F.col("pos"))
    return joined.select("doc_id", "mark", "item_id", start.alias("start"), length.alias("length"), kind.alias("match")).where("match IS NOT NULL")


def contamination_report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and mark (the hash of its text) for every row of docs."""
    windows = materialize(windows_of(items, width), "decon-windows")
    postings, anchors = build_index(docs, windows, width)
    # the window is no longer needed once it has matched: items and covered words are summed up apart, each distinct first
    found = materialize(match_windows(postings, anchors).select("doc_id", "mark", "item_id", "start", "length").distinct(), "decon-matches")
    covered = found.select("doc_id", "mark", "start", "length").distinct()
    covered = covered.select("doc_id", "mark", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word")).distinct()
    hits = covered.groupBy("doc_id", "mark").agg(F.count("*").alias("n_hit"))
    hit_items = found.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    report = materialize(_by_row(hits, hit_items, "inner"), "decon-report")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(words_of(F.col("text"), TEXT_SEPARATORS)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return _by_row(sizes, report, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "mark"
    )


def _by_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id (null equals null) and mark."""
    right = right.withColumnsRenamed({"doc_id": "row_id", "mark": "row_mark"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("mark") == F.col("row_mark")), how).drop("row_id", "row_mark")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    dirty = contamination_report(docs, items, width).where("contaminated").select(F.col("doc_id").alias("row_id"), F.col("mark").alias("row_mark")).distinct()
    dirty = materialize(dirty, "decon-dirty")
    same = docs["doc_id"].eqNullSafe(F.col("row_id")) & (F.xxhash64(docs["text"]) == F.col("row_mark"))
    return docs.join(broadcast_up_to(dirty, dirty.count()), same, "left_anti")
