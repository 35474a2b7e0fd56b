"""SimHash near-duplicates by meeting in the middle.

A text's fingerprint has 64 bits, one for each bit of its shingles' XXH64 values that is set in
over half of them. Two fingerprints within ``r`` bits have a common variant: one of them flips at
most ``r // 2`` bits to reach it, the other at most ``r - r // 2``. Each distinct fingerprint
emits its variants, they meet in a shuffle on the variant, and colliding pairs are verified. A
task sends the variants for one partition as a block of 10 bytes each: the variant, spread over
64 bits by an odd multiplier, and the number of the mask that gives the fingerprint back.

For r = 3 the emitted set is cut without losing a pair: fingerprints at odd distance have bit
counts of different parity, so only the even one flips two bits; among any three differing bits
two lie in the same half of the word, so only pairs of bits within a half are flipped.

In a bucket of colliding fingerprints each is linked to the smallest one that flipped at most
``r // 2`` bits. All of them lie within ``r`` bits of it, so the links are true, grow with the
rows only, and join the same components as all pairs would.

Defined cases: a null text counts as empty; fewer words than the shingle length give one shingle
of all words; no words give fingerprint 0, linked like any other; a component without ids has a
null component_id; a very long text is read whole; repeated rows are linked to each other and each
gets its row (``keep_one_of_each_group`` keeps one row of each group, so one of all texts without
words); an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, partitions_for, returning_memory, stored

BLOCK = 1 << 14
PRINTS_AT_ONCE = 4096
VARIANTS_EACH = 1_000_000
RANGES_EACH = 16                 # ranges of spread variants for each partition, to even them out
SPREAD = 0x9E3779B97F4A7C15      # an odd number near 2**64 / golden ratio
GATHER = pow(SPREAD, -1, 1 << 64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint (unsigned). Splits on ASCII white space, lower-cases A-Z only."""
    from xxhash import xxh64_intdigest
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    elif words == 3:
        shingles = [a + b" " + b + b" " + c for a, b, c in zip(tokens, tokens[1:], tokens[2:])]
    else:
        shingles = [b" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        h = np.array([xxh64_intdigest(s, seed) for s in shingles[at:at + BLOCK]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keep: tuple[str, ...] =
                 ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (long, the fingerprint's 64 bits) of every row."""
    schema = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                         F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for b in returning_memory(batches):
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("text")],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(fps)], schema.names)

    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    return slim.mapInArrow(run, schema).toDF(*keep, "fp")


def flips(r: int) -> tuple[np.ndarray, int, int]:
    """Masks, and how many of the first ones fingerprints of even and of odd bit count apply."""
    if not 0 <= r <= 3:
        raise ValueError("distances of 0 to 3 bits are supported")
    one = [1 << i for i in range(64)]
    two = [(1 << i) | (1 << j) for half in (0, 32) for i in range(half, half + 32)
           for j in range(half, i)]
    even = 1 + 64 * (r >= 2) + len(two) * (r == 3)
    odd = 1 + 64 * (r >= 1)
    return np.array([0, *one, *two][:max(even, odd)], np.uint64), even, odd


def _send_variants(r: int, ranges: int):
    """Blocks of variants by range of the spread variant."""
    masks, even, odd = flips(r)

    def blocks(prints: np.ndarray):
        mine = np.bitwise_count(prints) % 2 == 0
        variant = np.concatenate([(prints[own][:, None] ^ masks[None, :n]).reshape(-1)
                                  for own, n in ((mine, even), (~mine, odd))])
        mask = np.concatenate([np.tile(np.arange(n, dtype=np.uint16), own.sum())
                               for own, n in ((mine, even), (~mine, odd))])
        variant *= np.uint64(SPREAD)
        order = np.argsort(variant)
        variant, mask = variant[order], mask[order]
        at = ((variant >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        cuts = list(zip(start, np.r_[start[1:], len(at)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(at[start].astype(np.int32)),
             pa.array([variant[i:j].tobytes() for i, j in cuts], pa.binary()),
             pa.array([mask[i:j].tobytes() for i, j in cuts], pa.binary())],
            ["at", "variants", "masks"])

    def run(batches):
        for b in batches:
            prints = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(prints), PRINTS_AT_ONCE):
                yield blocks(prints[i:i + PRINTS_AT_ONCE])
    return run


def _bucket_links(r: int):
    """Links within the buckets of equal variants of one partition."""
    masks, _, _ = flips(r)

    def run(batches):
        blocks = [(np.frombuffer(v.as_py(), np.uint64), np.frombuffer(m.as_py(), np.uint16))
                  for b in batches for v, m in zip(b.column("variants"), b.column("masks"))]
        if not blocks:
            return
        variant = np.concatenate([x[0] for x in blocks])
        mask = np.concatenate([x[1] for x in blocks])
        blocks.clear()
        order = np.argsort(variant)
        variant, mask = variant[order], mask[order]
        start = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        size = np.diff(np.r_[start, len(variant)])
        shared = np.repeat(size > 1, size)
        variant, mask, size = variant[shared] * np.uint64(GATHER), mask[shared], size[size > 1]
        if not len(variant):
            return
        fp = (variant ^ masks[mask]).view(np.int64)
        start = np.r_[0, np.cumsum(size)[:-1]]
        near = np.bitwise_count(masks[mask]) <= r // 2
        none = np.iinfo(np.int64).max
        hub = np.repeat(np.minimum.reduceat(np.where(near, fp, none), start), size)
        close = np.bitwise_count((hub ^ fp).view(np.uint64)) <= r
        pick = (hub != fp) & close & np.repeat(np.logical_or.reduceat(near, start), size)
        pairs = np.unique(np.stack([hub[pick], fp[pick]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()),
                                          pa.array(pairs[:, 1].copy())], ["a", "b"])
    return run


def near_links(distinct: DataFrame, r: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join every pair within ``r``
    bits into one component. Each link is itself a verified pair."""
    spark = distinct.sparkSession
    _, even, odd = flips(r)
    n = partitions_for(spark, distinct.count() * (even + odd) // 2, VARIANTS_EACH)
    sent = distinct.select("fp").mapInArrow(_send_variants(r, n * RANGES_EACH),
                                            "at int, variants binary, masks binary")
    return (sent.repartition(n, "at").mapInArrow(_bucket_links(r), "a long, b long").distinct())


def near_duplicate_groups(docs: DataFrame, words: int = 3, max_distance: int = 3,
                          seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, fp, component_id and group_fp of every row. component_id is the smallest
    doc_id reachable over fingerprints that differ in at most ``max_distance`` bits, group_fp the
    smallest such fingerprint."""
    prints = fingerprints(docs, words, seed, keep).checkpoint()
    rows = prints.count()
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), rows)
    parts = connected_components(near_links(distinct.select("fp"), max_distance))
    linked = stored(distinct.join(parts, distinct.fp == parts.node, "left")
                    .select("fp", "first_id", F.coalesce("component", "fp").alias("group_fp")),
                    rows)
    least = linked.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    member = (linked.join(stored(least, rows), "group_fp")
              .select("fp", "component_id", "group_fp"))
    return prints.join(stored(member, rows), "fp").select(*keep, "fp", "component_id", "group_fp")


def keep_one_of_each_group(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest doc_id; among
    rows that share it (or have none), of the smallest hash of the row. Of rows equal in all
    columns one stays."""
    row = F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in docs.columns])
    groups = near_duplicate_groups(docs.select("doc_id", "text", row.alias("_llm_row")), words,
                                   max_distance, keep=("doc_id", "_llm_row"))
    first = stored(groups.groupBy("group_fp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_llm_row")).alias("f"))
        .select(F.col("f._llm_row").alias("_llm_first")), docs.count())
    again = F.row_number().over(Window.partitionBy("_llm_row").orderBy("_llm_row"))
    return (docs.withColumn("_llm_row", row)
            .join(first, F.col("_llm_row") == F.col("_llm_first"), "left_semi")
            .withColumn("_llm_again", again).where("_llm_again = 1")
            .select(*docs.columns))


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
