"""Ranked lexical search over a length-stratified index.

A document's length enters its score through the normaliser m = 50 + (50 n N) div L only, so
documents are grouped by equal m. A stratum is cut into blocks of bounded size; a block holds its
documents by id, and for each term the documents by tf (``term``: runs of equal tf, ``run``: the
documents of a run). Within a stratum a term adds the same amount to every document with the same
tf, so an impact w * ((10^9 tf) div (1000 tf + 20 m)) is computed once per run, not per posting.

A block's highest runs give for each query a bound on every score inside it. A search first visits
each query's ``TRIES`` blocks of highest bound; the k-th best score found there is a threshold,
and from then on a block whose bound is under the threshold is skipped for that query. Skipping is
exact: equal bounds are visited, because ties go to the smaller id.

Queries are taken in blocks of ``QUERY_BYTES`` of text (and one query more), so that what is
broadcast is bounded. ``rank`` knows its queries beforehand: if they fit one block it indexes
their terms only (statistics cover all documents and terms); otherwise it indexes all terms once.

Defined cases: null and empty texts have no terms, count in no statistic and are never found;
queries without terms get no rows; a null doc_id is ranked like any other and comes last among
equal scores; repeated documents are ranked each; rows equal in item_id and text are one query,
while an item_id with different texts ranks each text on its own; without documents there are no
rows; a very long text is read whole and is a block of its own if need be; only the id and text
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions_for, with_running_total

BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
POSTINGS_EACH = 200_000
QUERY_BYTES = 8 << 20
TRIES = 2
TERMS_KEPT = 200_000
#: ASCII letters in lower case, digits and all bytes of other characters; the rest separates
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127
                    else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return (text or b"").translate(_TERM_BYTES).split()


@dataclass
class Index:
    """``blocks``: one row per block; ``documents``: N; ``occurrences``: L."""
    blocks: DataFrame
    documents: int
    occurrences: int

    def save(self, path: str) -> None:
        self.blocks.write.parquet(f"{path}/blocks")
        self.blocks.sparkSession.createDataFrame(
            [(self.documents, self.occurrences)], "documents long, occurrences long"
        ).write.parquet(f"{path}/statistics")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        documents, occurrences = spark.read.parquet(f"{path}/statistics").first()
        return Index(spark.read.parquet(f"{path}/blocks"), documents, occurrences)


def term_vectors(docs: DataFrame, vocabulary: frozenset[bytes] | None) -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms with repeats, and the distinct terms (those in
    ``vocabulary``, if given) with their counts."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        has = None if known is None else known.value.__contains__
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            start, n, terms, tfs, ends = 0, [], [], [], [0]

            def rows(stop):
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.array(terms, pa.binary())),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.array(tfs, pa.int32()))],
                    ["doc_id", "n", "terms", "tfs"])

            for k in range(len(texts)):
                words = terms_of(texts[k].as_py())
                counts = Counter(words if has is None else filter(has, words))
                n.append(len(words))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                ends.append(len(terms))
                if len(terms) >= TERMS_KEPT:
                    yield rows(k + 1)
                    start, n, terms, tfs, ends = k + 1, [], [], [], [0]
            if n:
                yield rows(len(texts))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n long, terms array<binary>, tfs array<int>")


def _block(m: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row: the documents of ``parts`` and their postings by term and tf."""
    docs = pa.Table.from_batches(parts).combine_chunks()
    lists = docs["terms"].chunk(0)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    tf = docs["tfs"].chunk(0).flatten().to_numpy()
    at = np.repeat(np.arange(len(docs), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    order = np.lexsort((at, tf, code))
    code, tf = code[order], tf[order]
    head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])])
    of_term = code[head]
    first = np.flatnonzero(np.r_[True, of_term[1:] != of_term[:-1]])

    def one(values, kind):
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), one(docs["doc_id"].chunk(0), None),
         one(coded.dictionary, None), one(np.r_[first, len(head)], pa.int32()),
         one(tf[head], pa.int32()), one(np.r_[head, len(code)], pa.int32()),
         one(at[order], pa.int32())],
        ["m", "docs", "terms", "term", "tf", "run", "postings"])


def build_index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None) -> Index:
    """Index of ``docs`` (doc_id, text) over all terms, or those in ``vocabulary``."""
    vectors = term_vectors(docs, vocabulary).where("n > 0").checkpoint()
    documents, occurrences, postings = vectors.agg(
        F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", F.size("terms"))]).first()
    m = F.expr(f"100L - 50L + ((50L * n * {documents}L) div {max(occurrences, 1)}L)")
    # a stratum that holds very many documents is split by row; the sort keeps ids in order
    placed = (vectors.select(m.alias("m"), "doc_id", "terms", "tfs")
              .withColumn("row", F.monotonically_increasing_id()).where("size(terms) > 0")
              .repartitionByRange(partitions_for(docs.sparkSession, postings, POSTINGS_EACH),
                                  "m", "row")
              .sortWithinPartitions("m", F.asc_nulls_last("doc_id")))

    def run(batches):
        held, stratum, postings, rows = [], None, 0, 0
        for batch in batches:
            ms = batch.column("m").to_numpy()
            size = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
            lo = 0
            while lo < len(ms):
                if held and (ms[lo] != stratum or rows >= BLOCK_DOCS
                             or postings >= BLOCK_POSTINGS):
                    yield _block(stratum, held)
                    held, postings, rows = [], 0, 0
                stratum, before = int(ms[lo]), int(size[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(ms, stratum, "right")), lo + BLOCK_DOCS - rows,
                         1 + int(np.searchsorted(size, before + BLOCK_POSTINGS - postings)))
                held.append(batch.slice(lo, hi - lo))
                rows, postings, lo = rows + hi - lo, postings + int(size[hi - 1]) - before, hi
        if held:
            yield _block(stratum, held)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = placed.mapInArrow(
        run, f"m long, docs array<{id_type}>, terms array<binary>, term array<int>, "
             "tf array<int>, run array<int>, postings array<int>")
    return Index(blocks.withColumn("block", F.monotonically_increasing_id()).checkpoint(),
                 documents, occurrences)


@dataclass
class _Queries:
    """A block of queries: ids, the terms (positions in ``vocabulary``) of each, and weights."""
    ids: pa.Array
    vocabulary: pa.Array
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray | None = None


class _Visit:
    """One block of the index, as one block of queries sees it."""

    def __init__(self, row: dict, queries: _Queries):
        def values(name):
            return row[name].values.to_numpy(zero_copy_only=False)

        self.docs, self.postings, run, self.queries = (row["docs"].values, values("postings"),
                                                       values("run"), queries)
        of_query = pc.fill_null(pc.index_in(row["terms"].values, queries.vocabulary), -1)
        of_query, first = of_query.to_numpy(), values("term")
        weight = np.where(of_query < 0, 0, queries.weights[of_query])
        tf, m = values("tf").astype(np.int64), row["m"].as_py()
        gain = np.repeat(weight, np.diff(first)) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        self.gains = np.repeat(gain, np.diff(run))
        here = np.flatnonzero(of_query >= 0)
        self.span = np.zeros((len(queries.vocabulary), 2), np.int64)
        self.span[of_query[here], 0] = run[first[here]]
        self.span[of_query[here], 1] = run[first[here + 1]]
        highest = np.zeros(len(queries.vocabulary), np.int64)
        highest[of_query[here]] = gain[first[here + 1] - 1]
        self.bounds = np.add.reduceat(highest[queries.terms], queries.starts[:-1])

    def best(self, query: int, k: int, least: int):
        """Positions and scores of the k best documents with ``least`` or more."""
        score = np.zeros(len(self.docs), np.int64)
        q = self.queries
        for lo, hi in self.span[q.terms[q.starts[query]:q.starts[query + 1]]]:
            if hi > lo:
                score[self.postings[lo:hi]] += self.gains[lo:hi]
        found = np.flatnonzero(score >= least)
        if len(found) > k:
            found = found[np.lexsort((found, -score[found]))[:k]]
        return found, score[found]


def _rows(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k] for name in batch.schema.names}


def _query_blocks(items: DataFrame):
    """Blocks of queries as Arrow tables (item_id, text in UTF-8)."""
    items = (items.where("text is not null")
             .select("item_id", "text", F.octet_length("text").cast("long").alias("bytes"))
             .distinct())
    total = items.agg(F.sum("bytes")).first()[0]
    if total is None:
        return
    if total > QUERY_BYTES:
        items = with_running_total(items, ["item_id", "text"], "bytes").select(
            "item_id", "text", F.expr(f"before div {QUERY_BYTES}").alias("part")).checkpoint()
        parts = [items.where(F.col("part") == p) for p in range(total // QUERY_BYTES + 1)]
    else:
        parts = [items]
    for part in parts:
        queries = _queries(part.select("item_id", "text").toArrow().combine_chunks())
        if queries is not None:
            yield queries, len(parts)


def _queries(table: pa.Table) -> _Queries | None:
    number: dict[bytes, int] = {}
    keep, starts, terms = [], [0], []
    for k, text in enumerate(table["text"].cast(pa.large_binary()).to_pylist()):
        own = sorted(set(terms_of(text)))
        if own:
            keep.append(k)
            terms.extend(number.setdefault(t, len(number)) for t in own)
            starts.append(len(terms))
    if not keep:
        return None
    return _Queries(table["item_id"].take(pa.array(keep)).combine_chunks(),
                    pa.array(list(number), pa.binary()), np.array(starts), np.array(terms))


def _weights(index: Index, vocabulary: pa.Array) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each term."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        df = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for row in _rows(batch):
                at = pc.fill_null(pc.index_in(row["terms"].values, shared.value), -1).to_numpy()
                run_at = row["run"].values.to_numpy()
                held = np.diff(run_at[row["term"].values.to_numpy()])
                np.add.at(df, at[at >= 0], held[at >= 0])
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])],
                                         ["at", "df"])

    df = np.zeros(len(vocabulary), np.int64)
    for at, n in (index.blocks.select("terms", "term", "run")
                  .mapInArrow(run, "at int, df long").groupBy("at").agg(F.sum("df")).collect()):
        df[at] = n
    return np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(n) + 1)))
                     for n in df], np.int64)


def _first_visits(index: Index, shared) -> dict[int, list[int]]:
    """Block -> the queries that visit it first: each has ``TRIES`` blocks of highest bound."""
    def run(batches):
        q = shared.value
        best = np.zeros((TRIES, len(q.ids)), np.int64)
        block = np.full((TRIES, len(q.ids)), -1, np.int64)
        for batch in batches:
            for row in _rows(batch):
                bound, mine = _Visit(row, q).bounds, np.full(len(q.ids), row["block"].as_py())
                for t in range(TRIES):
                    up = bound > best[t]
                    best[t], bound = np.where(up, bound, best[t]), np.where(up, best[t], bound)
                    block[t], mine = np.where(up, mine, block[t]), np.where(up, block[t], mine)
        for t in range(TRIES):
            has = np.flatnonzero(block[t] >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(has, pa.int32()), pa.array(block[t][has]), pa.array(best[t][has])],
                ["query", "block", "bound"])

    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    visits: dict[int, list[int]] = {}
    for query, block in (index.blocks.mapInArrow(run, "query int, block long, bound long")
                         .withColumn("place", F.row_number().over(order))
                         .where(F.col("place") <= TRIES).select("query", "block").collect()):
        visits.setdefault(block, []).append(query)
    return visits


def _thresholds(index: Index, shared, k: int) -> np.ndarray:
    """The k-th best score of each query in the blocks it visits first (1, if there are fewer)."""
    visits = _first_visits(index, shared)

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                visit = _Visit(row, shared.value)
                for query in visits[row["block"].as_py()]:
                    _, score = visit.best(query, k, 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([query] * len(score), pa.int32()), pa.array(score)],
                        ["query", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"))
    found = (index.blocks.where(F.col("block").isin(list(visits)))
             .mapInArrow(run, "query int, score long")
             .withColumn("place", F.row_number().over(order)).where(F.col("place") == k))
    least = np.ones(len(shared.value.ids), np.int64)
    for query, score in found.select("query", "score").collect():
        least[query] = score
    return least


def _search_block(index: Index, queries: _Queries, k: int, id_type: str) -> DataFrame:
    spark = index.blocks.sparkSession
    queries.weights = _weights(index, queries.vocabulary)
    shared = spark.sparkContext.broadcast(queries)
    least = spark.sparkContext.broadcast(_thresholds(index, shared, k))

    def run(batches):
        q, floor = shared.value, least.value.copy()
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in _rows(batch):
                visit = _Visit(row, q)
                for query in np.flatnonzero(visit.bounds >= floor):
                    at, score = visit.best(query, k, floor[query])
                    if not len(at):
                        continue
                    top = np.sort(np.r_[best.get(query, score[:0]), score])[-k:]
                    best[query] = top
                    if len(top) == k:
                        floor[query] = max(floor[query], top[0])
                    same = pa.array(np.full(len(at), query), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [same, q.ids.take(same), visit.docs.take(pa.array(at)),
                         pa.array(score)], ["query", "item_id", "doc_id", "score"])

    doc_type = index.blocks.schema["docs"].dataType.elementType.simpleString()
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (index.blocks.mapInArrow(run, f"query int, item_id {id_type}, doc_id {doc_type}, "
                                         "score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _no_rows(spark: SparkSession, items: DataFrame, id_type: T.DataType) -> DataFrame:
    return spark.createDataFrame([], T.StructType([
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type),
        T.StructField("score", T.LongType())]))


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of ``items`` (item_id,
    text) with a score above 0. Queries whose terms the index leaves out find nothing by them."""
    out = _no_rows(index.blocks.sparkSession, items,
                   index.blocks.schema["docs"].dataType.elementType)
    for queries, _ in _query_blocks(items):
        out = out.unionByName(_search_block(
            index, queries, k, items.schema["item_id"].dataType.simpleString()))
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` of ``items`` in an index of ``docs``."""
    index, out = None, _no_rows(docs.sparkSession, items, docs.schema["doc_id"].dataType)
    for queries, parts in _query_blocks(items):
        if index is None:
            index = build_index(docs, frozenset(queries.vocabulary.to_pylist())
                                if parts == 1 else None)
        out = out.unionByName(_search_block(
            index, queries, k, items.schema["item_id"].dataType.simpleString()))
    return out
