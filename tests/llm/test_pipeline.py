"""The pipeline's stages on the smallest table, each against its own input."""

from collections import Counter

import corpus_pipeline
from loadcast.llm import quality
from loadcast.llm.common import stage
from test_shingles import plain_kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf), f"test-{name}")
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in kept["quality"]} == {i for i, r in source.items() if quality.passes(
        quality.Text(r.text.encode()), quality.RULES, list(quality.RULES))}
    assert all(r == source[r.doc_id] for r in kept["quality"])
    once = {r.doc_id for r in kept["near_duplicates"]}
    assert once == plain_kept(kept["quality"])
    assert sorted(r.doc_id for r in kept["personal_data"]) == sorted(once)
    assert not any("@mail" in r.text for r in kept["personal_data"])
    assert all(r.n_chars == len(r.text) for r in kept["personal_data"])
    copies = Counter(r.doc_id for r in kept["mix"])
    assert set(copies) <= once and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in kept["pack"] if r.piece == 0) == copies
