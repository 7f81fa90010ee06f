"""The registered queries of the corpus operators: ``opN_<name>(spark, sf_dir)`` over whole tables."""

from __future__ import annotations

import public_tokenizers

from tanik.llm import bpe, embeddings, hnsw, langid, minhash, negatives, packing, pii, quality, repeats, turns, warc, weighting
from tanik.session import table


def op1_revisits(spark, sf_dir):
    """Not-modified revisits of all pages resolved to stored responses."""
    return warc.digest(table(spark, sf_dir, "pages"))


def op2_packing(spark, sf_dir):
    """Every text of documents as tokens, packed into sequences of at most 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark, sf_dir):
    """A quality score of every text of documents, learned from labels."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark, sf_dir):
    """Every text of documents encoded and decoded with a word-end vocabulary."""
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_neardup(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return minhash.link_documents(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    """Personal data in every text of documents."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    """The language of every text of documents."""
    return langid.classify(table(spark, sf_dir, "documents"))


def op8_vectors(spark, sf_dir):
    """Near-duplicate vectors of embeddings within labels."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_neighbours(spark, sf_dir):
    """The 10 nearest vectors of every hundredth vector of embeddings."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op10_repeats(spark, sf_dir):
    """Passages that repeat across all documents, removed from all but the first."""
    return repeats.digest(table(spark, sf_dir, "documents"))


def op11_repair(spark, sf_dir):
    """The cheapest repair of every conversation after planted damage."""
    return turns.digest(table(spark, sf_dir, "conversations"))


def op12_weighting(spark, sf_dir):
    """A context-tree-weighting score of every text of documents."""
    return weighting.digest(table(spark, sf_dir, "documents"))


def op13_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector of embeddings."""
    return negatives.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_revisits, op2_packing, op3_quality, op4_bpe, op5_neardup, op6_pii, op7_language, op8_vectors, op9_neighbours, op10_repeats, op11_repair, op12_weighting, op13_negatives)}
