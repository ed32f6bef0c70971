"""What operators leave on disk while they run."""

from pathlib import Path

from wardline.llm import common, substring_dedup, toxicity
from wardline.sources import staging


def tables(spark):
    return {p.name for p in Path(staging.shared_dir(spark).removeprefix("file://"), "wardline").glob("*")}


def test_toxicity_leaves_no_tables_of_its_training(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    before = tables(spark)
    model = toxicity.train(docs, labels)
    assert tables(spark) <= before, tables(spark) - before
    sent = model.sent
    rows = toxicity._scored(docs.selectExpr("doc_id", "false", "text"), model)
    assert model.sent is sent and rows.count() == docs.count(), "the tables are sent once"


def test_substring_dedup_leaves_ranges_only(spark, monkeypatch):
    """Copies, and passages that differ but share windows, also if nothing is broadcast; the tables on the way go."""
    run = [f"w{i}" for i in range(140)]
    rows = [(1, run), (2, run), (3, run[:70] + ["x"] + run[70:]), (4, ["a", "b", *run[20:90]]), (5, [f"v{i}" for i in range(80)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    expected = {1: 0, 2: 140, 3: 140, 4: 70, 5: 0}
    for limit in (common.BROADCAST_BYTES, 1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        before = tables(spark)
        out = substring_dedup.digests(docs)
        left = {name.split("-")[0] for name in tables(spark) - before}
        assert left <= {"ranges", "filter"}, left
        assert {r.doc_id: r.n_removed for r in out.collect()} == expected
