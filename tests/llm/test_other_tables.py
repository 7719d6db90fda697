"""Vectors, conversations and pages against plain Python and round trips."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoframe.llm import chat, queries, vectors, warc


@pytest.fixture(scope="module")
def embeddings():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.4)).astype(np.float32).tolist()) for i in range(300)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, rows[0][1]), (909, rows[0][1])]
    return rows + odd


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_duplicate_vectors(spark, embeddings, kind, monkeypatch):
    df = spark.createDataFrame([(i, v, 1) for i, v in embeddings], f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    assert as_dict(vectors.near_duplicates(df)) == brute.vector_classes(embeddings)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40), monkeypatch.setattr(vectors, "LEAF_ROWS", 8)
    assert as_dict(vectors.near_duplicates(df)) == brute.vector_classes(embeddings)


def test_vectors_of_extreme_size_and_null_ids(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, -1.0]), (None, [1.0, 1.0])]
    got = as_dict(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[3] == (0, 3, True) and got[None][0] == 0


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    only = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert as_dict(vectors.near_duplicates(only)) == {1: (0, 1, True)}


CHATS = [
    (1, 0, "system", "You are </s> kind"), (1, 1, "user", "hi <s>[user]\n there"), (1, 2, "assistant", "back\\slash \\e \\\\ [/INST]"), (1, 3, "user", ""), (1, 4, "assistant", None),
    (2, 5, "assistant", "starts late ñ \U0001f600"), (2, 5, "assistant", "starts late ñ \U0001f600"), (2, None, None, "no role"), (None, 1, "user", "x"), (3, 1, "a]\nb", "]\n</s>\n"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("budget", "turns", "tokens"), [(2048, 2, 256), (4, 1, 2), (1, 3, 100), (10, 0, 0)])
def test_chat_round_trip(spark, budget, turns, tokens):
    long = [(9, i, ("user", "assistant")[i % 2], f"word {i} " * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(CHATS + long, SCHEMA)
    windows = chat.chat_windows(df, budget, turns, tokens)
    read = chat.read_windows(windows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w")).collect()
    got = {}
    for r in read:
        said = [(t["role"], t["text"]) for w in r.w for t in w["turns"]]
        loss = "".join(x for w in r.w for x in w["loss"])
        got[r.conv_id] = (len(said), brute.sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), brute.sha(loss))
    assert got == brute.chats(CHATS + long)


def test_windows_keep_the_system_turn_and_repeat_history(spark):
    rows = [(1, 0, "system", "sys")] + [(1, i, ("assistant", "user")[i % 2], "w " * 10) for i in range(1, 20)]
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), 60, 1, 10).orderBy("window").collect()
    assert len(windows) > 3
    for w in windows[1:]:
        assert w.formatted.startswith("<s>[system]\nsys</s>\n") and w.new_from > len("<s>[system]\nsys</s>\n")
        assert all(s["start"] >= w.new_from for s in w.loss_spans)
        assert budget_tokens(w) <= 60


def budget_tokens(window):
    return sum(max(1, len(t.partition("]\n")[2].split())) for t in window.formatted.split("</s>\n") if t)


def test_windows_keep_the_budget(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 0, "system", "s " * 20), (1, 1, "user", "w " * 860), (1, 2, "assistant", "w " * 1200)]
    rows += [(c, i, ("assistant", "user")[i % 2], "w " * int(rng.choice([1, 30, 300, 900, 1500, 2048]))) for c in range(2, 6) for i in range(40)]
    for w in chat.chat_windows(spark.createDataFrame(rows, SCHEMA)).collect():
        assert budget_tokens(w) <= 2048


def test_chat_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame(CHATS, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat_format(spark, str(tmp_path)).collect()}
    assert got == brute.chats([*CHATS, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert chat.chat_windows(spark.createDataFrame([], SCHEMA)).collect() == []


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "ñ" * 5000), (6, "u", "line\r\n\r\nWARC/1.1\r\n"), (9, "u", "<p>x</p>")]


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha256 string")
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == len({h or "" for _, _, h in PAGES})
    records = warc.record_fields(warc.read_archive(archive)).withColumns({"n": F.octet_length("payload"), "d": warc.base32_sha1(F.col("payload"))}).collect()
    assert {r.record_page: (r.n, r.d, r.record_type, r.refers_to) for r in records} == brute.archive([(p, h) for p, _, h in PAGES])
    for r in records:
        assert bytes(r.payload).decode() == (dict((p, h) for p, _, h in PAGES)[r.record_page] or "") and r.declared_digest == r.d
    warc.export_warc_text(warc.read_archive(archive), f"{tmp_path}/warc")
    assert all(r.header.count("WARC-Date: ") == 1 for r in records) and len({r.header.split("WARC-Record-ID: ")[1].split("\r")[0] for r in records}) == len(PAGES)
    replayed = {r.record_page: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.replay_records(archive).collect()}
    assert replayed == brute.archive([(p, h) for p, _, h in PAGES])
    broken = archive.payloads.withColumn("payload", F.when(F.octet_length("payload") > 9, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("payload")))
    for read in (warc.read_archive, warc.replay_records):
        with pytest.raises(Exception, match="differs from its digest"):
            read(warc.Archive(archive.headers, broken)).collect()
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/warc", wholetext=True).collect())
    assert text.count("WARC-Record-ID: ") == len(PAGES)


def test_archive_minimum_repeats_and_empty(spark):
    pages = spark.createDataFrame(PAGES + PAGES[-1:], "page_id long, url string, html string")
    kinds = {}
    for r in warc.record_fields(warc.read_archive(warc.write_archive(pages, min_revisit_bytes=5))).collect():
        kinds.setdefault(r.record_page, []).append(r.record_type)
    assert kinds[3] == kinds[4] == ["response"] and kinds[1] == ["revisit"] and kinds[9] == ["response"] * 2
    assert warc.read_archive(warc.write_archive(pages.limit(0))).collect() == []
    nulls = spark.createDataFrame([(None, "u", "a"), (None, "u", "a"), (1, "u", "a")], "page_id long, url string, html string")
    assert warc.read_archive(warc.write_archive(nulls)).count() == 3


def test_archive_spreads_a_hot_digest_and_leaves_no_tables(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    tables = {t.name for t in spark.catalog.listTables()}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        html = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("page "), F.col("id").cast("string")))
        pages = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
        got = warc.replay_records(warc.write_archive(pages)).withColumn("task", F.spark_partition_id())
        hot = got.where("record_type = 'revisit'").groupBy("task").agg(F.count("*").alias("n"), F.min("refers_to").alias("lo"), F.max("refers_to").alias("hi")).collect()
        assert sum(r.n for r in hot) == 9_999 and len(hot) > 1 and max(r.n for r in hot) < 9_999 and {(r.lo, r.hi) for r in hot} == {(19_998, 19_998)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {t.name for t in spark.catalog.listTables()} == tables
