"""The pipeline's pack stage: a smaller lookup and smaller slices bound a worker's memory, never the result."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from loadcast.llm import packing, tokens
from loadcast.llm.queries import WORD_VOCABULARY

PATH = public_tokenizers.path(WORD_VOCABULARY)


@pytest.mark.parametrize("kept, slice_bytes", [(1, 1), (50, 2000), (5000, 50_000)])
def test_bounds_change_no_piece(spark, sf, kept, slice_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(2, "doc_id")
    pieces = [Counter(tuple(r) for r in packing.token_pieces(docs, PATH, **bounds).drop("part", "rank_in_part").collect())
              for bounds in ({}, {"chunks_kept": kept, "slice_bytes": slice_bytes})]
    assert pieces[0] == pieces[1]


def test_lookup_is_forgotten_at_its_bound():
    own = tokens.tokenizer(PATH, 300)
    assert own.chunks_kept == 300
    for k in range(50):
        own.encode(tokens.pa.array([" ".join(f"word{k}x{j}" for j in range(20))]))
        assert len(own.slots) <= 300


def test_the_pipeline_asks_for_the_smaller_bounds(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "pack_documents", lambda docs, path, **bounds: asked.append(bounds))
    corpus_pipeline.packed(spark, None, sf)
    assert asked[0]["chunks_kept"] < tokens.CHUNKS_KEPT and asked[0]["slice_bytes"] < tokens.SLICE_BYTES
