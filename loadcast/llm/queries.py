"""One registered query for each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (chunk_sentencepiece, collocation_streams, hilbert_shards, host_boilerplate,
               kn_toxicity, license_automaton, line_templates, partition_ann, pii_votes,
               pruned_graph, simhash_balls, stratified_search, sumsq_packing)
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_line_templates(spark, sf_dir):
    """Per document: lines, dropped lines, and the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs).select(
        "doc_id", F.col("_llm_lines").alias("n_lines"), F.col("_llm_dropped").alias("n_dropped"),
        "text")


def op2_learned_partitions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return partition_ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_weak_supervision(spark, sf_dir):
    return pii_votes.annotate(table(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark, sf_dir):
    placed = hilbert_shards.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op5_distinct_chunks(spark, sf_dir):
    return chunk_sentencepiece.encode_digests(table(spark, sf_dir, "documents"),
                                              _tokenizer("piece_bpe_32k.model"))


def op6_simhash_balls(spark, sf_dir):
    groups = simhash_balls.near_duplicate_groups(table(spark, sf_dir, "documents"), 3, 3)
    return groups.select("doc_id", simhash_balls.fingerprint_hex().alias("fingerprint"),
                         "component_id")


def op7_host_suffixes(spark, sf_dir):
    found = host_boilerplate.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_sum_of_squares(spark, sf_dir):
    return sumsq_packing.pack_documents(table(spark, sf_dir, "documents"),
                                        _tokenizer("word_bpe_49k.json"))


def op9_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = kn_toxicity.score_documents(docs, table(spark, sf_dir, "labels"), keep=("doc_id",))
    return scored.select("doc_id", (kn_toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_pruned_graph(spark, sf_dir):
    return pruned_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_stratified_search(spark, sf_dir):
    return stratified_search.rank(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                  table(spark, sf_dir, "benchmark").select("item_id", "text"), 50)


def op12_count_streams(spark, sf_dir):
    return collocation_streams.collocations(table(spark, sf_dir, "documents"))


def op13_suffix_automaton(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = license_automaton.scan(docs)
    span = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["stop"]))
    return scanned.select("doc_id", *license_automaton.digest(),
                          F.array_join(span, ",").alias("spans"))


REGISTRY = {f.__name__: f for f in (
    op1_line_templates, op2_learned_partitions, op3_weak_supervision, op4_hilbert_shards,
    op5_distinct_chunks, op6_simhash_balls, op7_host_suffixes, op8_sum_of_squares,
    op9_kneser_ney, op10_pruned_graph, op11_stratified_search,
    op12_count_streams, op13_suffix_automaton)}
