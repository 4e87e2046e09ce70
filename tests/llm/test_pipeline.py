"""The pipeline's stages, each against brute force on what it was given."""

from collections import Counter

import corpus_pipeline
from terrazo.llm import decontaminate
from terrazo.llm.queries import QUERIES

from . import brute


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.columns[: len(columns)] == columns or name == "sharding"
        out = docs.collect()
        for r in out:
            assert all(r[c] == rows[r["doc_id"]][c] for c in columns)
        kept[name] = Counter(r["doc_id"] for r in out)
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    assert set(kept["toxicity"]) == {i for i, p in scores.items() if p == 0}
    left = [(i, rows[i]["text"]) for i in kept["toxicity"]]
    assert set(kept["ngram_jaccard_join"]) == {c for _, c in brute.classes(left, 5, 80).values()}
    gone = set(kept["ngram_jaccard_join"]) - set(kept["benchmark_decontamination"])
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i in kept["ngram_jaccard_join"] if any(x in rows[i]["text"] for x in items)} <= gone
    assert max(kept["mixing"].values()) <= 3 and kept["mixing"] == kept["sharding"]
    assert decontaminate.RATE == 0.1


def test_run_repeats(spark, sf):
    a, b = (Counter((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, sf).select("doc_id", "shard").collect()) for _ in range(2))
    assert Counter(k[0] for k in a.elements()) == Counter(k[0] for k in b.elements())
