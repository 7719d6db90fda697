"""The corpus pipeline's stages, each against plain Python on its own input."""

import brute
import pytest
from corpus import DOCS, make_documents


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = make_documents()
    junk = [(1000 + i, "BUY!! NOW!! " * 20 + f"OFFER{i}!!", "en", "a", 0) for i in range(30)]
    spark.createDataFrame(docs + junk, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 1000), 0) for d, *_ in docs + junk], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, docs[5][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline as pipeline

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        after = spark.read.parquet(f"{folder}/stage{i}")
        if i < 4:
            assert after.columns == docs.columns
        before = {r.doc_id: r.text for r in docs.collect()}
        kept = {r.doc_id: r.text for r in after.collect()}
        seen.append((before, kept))
        docs = after
    before, kept = seen[0]
    assert not any(d >= 1000 for d in kept) and len(kept) > 40
    before, kept = seen[1]
    keepers = brute.line_keepers(before.items())
    left = {d: sum(keepers.get((d, n), False) for n in range(len((t or "").split("\n")))) for d, t in before.items()}
    had = {d: any((d, n) in keepers for n in range(len((t or "").split("\n")))) for d, t in before.items()}
    assert set(kept) == {d for d in before if left[d] or not had[d]}
    before, kept = seen[2]
    assert set(kept) == {d for d, (_, c) in brute.jaccard_classes(list(before.items())).items() if c == d}
    before, kept = seen[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(kept) == {d for d, v in brute.leaks(list(before.items()), items).items() if not v[4]}
    before, kept = seen[4]
    assert set(kept) <= set(before) and kept


def test_run(spark, folder):
    import corpus_pipeline as pipeline

    rows = pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "text", "copies", "taken", "target"} <= set(rows[0].asDict())
