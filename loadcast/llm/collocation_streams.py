"""Phrase collocations from sorted count streams.

Every word occurrence starts one run of three words within its piece (shorter at the piece's
end), so the sorted runs are one stream that holds the counts of all single words, pairs and
triples: equal beginnings stand together. A task turns about ``CHUNK_TOKENS`` words at a time into
sorted runs with counts, cuts them at bounds that all tasks share, and hands each stretch on as
one compressed block. A stretch of the stream is then merged in one place. Bounds come from
places picked at random in proportion to the length of the texts; they balance the stretches and
have no influence on results. A pair that very many runs begin with is cut like any other
stretch: only its sums at both ends of a stretch are added up afterwards.

What reaches ``min_count`` is laid out twice, in prefix order (words as they stand) and in suffix
order (last word first). In prefix order a phrase follows its first word and its first two words;
in suffix order its last word and its last two words. One walk through each stream therefore reads
the count of every first part, of every rest, and of the longer phrases that extend a pair, in
lockstep: no hash table, no join. Stretches of a stream are walked side by side; the counts that
are open at a stretch's beginning and end (a few numbers a stretch) come from its neighbours.

Defined cases: a null text is empty, a null lang is ``und`` (together with rows that say so);
repeated rows count each; a very long text is read whole, in chunks; without phrases there are no
rows; only text and lang are read, so other columns may have any names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for

CHUNK_TOKENS = 2_000_000
ID_BITS = 21
STRETCH_TOKENS = 3_000_000
PICKS_EACH = 64
PICK_BYTES = 400
BOUND_BYTES = 64
ROWS_EACH = 50_000
END = b"."
_GRAMS = "lang string, size int, w1 string, w2 string, w3 string, f long"
#: ASCII letters in lower case; what ends a piece reads as END, which no word holds
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else END[0] if c in b".,;:!?\n\x0b\x0c\r"
                    else 32 if c == 9 else c for c in range(256))


def tokens_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, with ``END`` wherever a piece ends."""
    return (text or b"").translate(_WORD_BYTES).replace(END, b" . ").split()


# ------------------------------------------------------------------------------ counting
def _bounds(docs: DataFrame, size: int, stretches: int) -> list[tuple[bytes, ...]]:
    """Up to ``stretches - 1`` ascending (lang, w1, w2, w3) that cut the stream evenly."""
    rate = PICKS_EACH * stretches / max(size, 1)

    def run(batches):
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            length = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            picks = rng.poisson(length * rate)
            out = []
            for k in np.flatnonzero(picks):
                text, lang = texts[int(k)].as_py(), batch.column("lang")[int(k)].as_py()
                for at in rng.integers(0, len(text), picks[k]):
                    # the first word is cut off, as it may have begun earlier
                    run_of = tokens_of(text[at:at + PICK_BYTES])[1:]
                    run_of = run_of[1:4] if run_of[:1] == [END] else run_of[:3]
                    if END in run_of:
                        run_of = run_of[:run_of.index(END)]
                    if run_of:
                        out.append([lang.encode(), *[w[:BOUND_BYTES] for w in run_of],
                                    b"", b""][:4])
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.binary())
                                              for j in range(4)], ["lang", "w1", "w2", "w3"])

    picked = docs.mapInArrow(run, "lang binary, w1 binary, w2 binary, w3 binary").toArrow()
    found = sorted(zip(*[picked.column(c).to_pylist() for c in picked.column_names]))
    step = len(found) / stretches
    return sorted({found[int(k * step)] for k in range(1, stretches)}) if found else []


def _pack(key: np.ndarray, counts: np.ndarray, words: pa.Array) -> bytes:
    """One block: ascending runs of word numbers (0: none; else a position in ``words`` plus 1)
    and their counts, with the words that occur."""
    mask = (1 << ID_BITS) - 1
    columns = [key >> (2 * ID_BITS), (key >> ID_BITS) & mask, key & mask]
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    own = words.take(pa.array(used - 1))
    kind = np.uint16 if len(used) < 0xFFFF else np.uint32
    number = np.zeros(used[-1] + 1, kind)
    number[used] = np.arange(1, len(used) + 1)
    plain = b"".join([np.array([len(key), len(used), np.dtype(kind).itemsize], np.int64).tobytes(),
                      counts.astype(np.int64).tobytes(),
                      pc.binary_length(own).to_numpy().astype(np.int64).tobytes(),
                      *[number[c].tobytes() for c in columns], b"".join(own.to_pylist())])
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpack(block: bytes):
    """Three columns of word numbers, counts, and the words, of a block of ``_pack``."""
    plain = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
    n, k, width = np.frombuffer(plain, np.int64, 3)
    at = 24
    counts = np.frombuffer(plain, np.int64, n, at)
    lengths = np.frombuffer(plain, np.int64, k, at := at + 8 * n)
    at += 8 * k
    columns = [np.frombuffer(plain, f"u{width}", n, at + width * n * j) for j in range(3)]
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), int(k), [None, pa.py_buffer(ends.tobytes()),
                                    pa.py_buffer(plain[at + 3 * width * n:])])
    return columns, counts, words


def _stretches(lang: bytes, tokens: list[bytes], fresh: int, bounds: list[tuple[bytes, ...]]):
    """(stretch, block) of the runs that start at the first ``fresh`` tokens."""
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order))
    plain = words.to_pylist()
    number = np.empty(len(order), np.int64)
    end = bisect_left(plain, END)
    if end < len(plain) and plain[end] == END:     # END is number 0: no word
        order = np.r_[order[:end], order[end + 1:]]
        number[coded.dictionary.index(END).as_py()] = 0
        plain.pop(end)
        words = pa.array(plain, pa.large_binary())
    number[order] = np.arange(1, len(order) + 1)
    ids = np.r_[number[coded.indices.to_numpy()], 0, 0]
    first, second = ids[:fresh], ids[1:fresh + 1]
    third = np.where(second > 0, ids[2:fresh + 2], 0)
    key = ((first << (2 * ID_BITS)) | (second << ID_BITS) | third)[first > 0]
    if not len(key):
        return
    key, counts = np.unique(key, return_counts=True)

    def least(bound):
        """The smallest number of a run that does not sort before ``bound``."""
        out = 0
        for j, word in enumerate(bound[1:]):
            at = bisect_left(plain, word)
            exact = at < len(plain) and plain[at] == word
            out |= (0 if word == b"" else at + 1) << (ID_BITS * (2 - j))
            if word != b"" and not exact:
                break
        return out

    lo, hi = bisect_left(bounds, (lang,)), bisect_left(bounds, (lang + b"\0",))
    cuts = [0, *np.searchsorted(key, [least(b) for b in bounds[lo:hi]]), len(key)]
    for j in range(len(cuts) - 1):
        if cuts[j] < cuts[j + 1]:
            part = slice(cuts[j], cuts[j + 1])
            yield lo + j, _pack(key[part], counts[part], words)


def _blocks(docs: DataFrame, bounds) -> DataFrame:
    """(stretch, lang, block) of all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def rows(lang, tokens):
        out = []
        for at in range(0, len(tokens), CHUNK_TOKENS):
            chunk = tokens[at:at + CHUNK_TOKENS + 2]
            out += _stretches(lang.encode(), chunk, min(CHUNK_TOKENS, len(tokens) - at),
                              shared.value)
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in out], pa.int32()), pa.array([lang] * len(out), pa.string()),
             pa.array([b for _, b in out], pa.binary())], ["stretch", "lang", "block"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        total = 0
        for batch in batches:
            texts, langs = batch.column("text").cast(pa.large_binary()), batch.column("lang")
            for k in range(len(texts)):
                tokens = tokens_of(texts[k].as_py())
                mine = held.setdefault(langs[k].as_py(), [])
                mine += tokens
                mine.append(END)
                total += len(tokens) + 1
                if total >= CHUNK_TOKENS:
                    for lang, words in held.items():
                        yield rows(lang, words)
                    held, total = {}, 0
        for lang, words in held.items():
            yield rows(lang, words)

    return docs.mapInArrow(run, "stretch int, lang string, block binary")


def _merge(table: pa.Table, min_count: int) -> pa.Table:
    """Counts of one stretch: phrases of ``min_count`` and more, the pairs and single words at
    both ends whatever their count, and (size 0) the number of words."""
    out = []
    for lang in pc.unique(table["lang"]).to_pylist():
        parts = [_unpack(b) for b in
                 table.filter(pc.equal(table["lang"], lang))["block"].to_pylist()]
        coded = pa.concat_arrays([w for _, _, w in parts]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        number = number[coded.indices.to_numpy()]
        columns, at = [[], [], []], 0
        for ids, _, words in parts:
            table_of = np.r_[0, number[at:at + len(words)]]
            at += len(words)
            for j in range(3):
                columns[j].append(table_of[ids[j]])
        runs = [np.concatenate(c) for c in columns]
        counts = np.concatenate([c for _, c, _ in parts])
        words, bits = coded.dictionary.take(pa.array(order)), len(order).bit_length()
        if 3 * bits <= 63:
            place = np.argsort((runs[0] << (2 * bits)) | (runs[1] << bits) | runs[2])
        else:
            place = np.lexsort(runs[::-1])
        runs, counts = [c[place] for c in runs], counts[place]
        new = np.zeros(len(counts), bool)
        new[0] = True
        rows = [(0, np.zeros(1, np.int64), np.array([counts.sum()]))]
        for size in (1, 2, 3):
            new[1:] |= runs[size - 1][1:] != runs[size - 1][:-1]
            start = np.flatnonzero(new)
            f = np.add.reduceat(counts, start)
            keep = f >= min_count
            if size < 3:
                keep[[0, -1]] = True
            keep &= runs[size - 1][start] > 0
            rows.append((size, start[keep], f[keep]))
        for size, start, f in rows:
            held = [words.take(pa.array(runs[j][start] - 1)) if j < size
                    else pa.array([b""] * len(f), pa.large_binary()) for j in range(3)]
            out.append(pa.table([pa.array([lang] * len(f), pa.string()),
                                 pa.array([size] * len(f), pa.int32()),
                                 *[h.cast(pa.large_string()).cast(pa.string()) for h in held],
                                 pa.array(f, pa.int64())],
                                ["lang", "size", "w1", "w2", "w3", "f"]))
    return pa.concat_tables(out)


def phrase_counts(docs: DataFrame, min_count: int) -> DataFrame:
    """(lang, size, w1, w2, w3, f) of all phrases of ``size`` 1 to 3 words with f >= min_count
    (unused words are empty), and with size 0 the number of words of each lang."""
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und"))
                       .alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    stretches = partitions_for(spark, size // 6, STRETCH_TOKENS)
    blocks = _blocks(docs, _bounds(docs, size, stretches))
    merged = blocks.groupBy("stretch").applyInArrow(
        lambda table: _merge(table, min_count), _GRAMS)
    return (merged.groupBy("lang", "size", "w1", "w2", "w3").agg(F.sum("f").alias("f"))
            .where(f"size = 0 or f >= {int(min_count)}"))


# ------------------------------------------------------------------------------ streams
def _ends(stream: DataFrame) -> tuple[dict, dict]:
    """Of each stretch of a stream: the counts of the word and of the pair that are open at its
    beginning, and the highest triple that still extends its last pair in later stretches."""
    def run(batches):
        table = pa.Table.from_batches(list(batches))
        size, f = table["size"].to_numpy(), table["f"].to_numpy()
        shorter = np.flatnonzero(size < 3)
        lead = f[:shorter[0] if len(shorter) else len(f)]

        def last(k):
            at = np.flatnonzero(size == k)
            return int(f[at[-1]]) if len(at) else None

        yield pa.RecordBatch.from_pylist(
            [{"stretch": int(table["stretch"][0].as_py()), "word": last(1), "pair": last(2),
              "lead": int(lead.max(initial=0)), "through": not len(shorter)}],
            pa.schema([("stretch", pa.int32()), ("word", pa.int64()), ("pair", pa.int64()),
                       ("lead", pa.int64()), ("through", pa.bool_())]))

    # a task without rows has no batch and gives no row: nothing is open there
    some = stream.mapInArrow(lambda batches: run(b) if (b := _filled(batches)) else iter(()),
                             "stretch int, word long, pair long, lead long, through boolean")
    ends = sorted(some.collect())
    opened, extended, word, pair = {}, {}, 0, 0
    for e in ends:
        opened[e.stretch] = (word, pair)
        word, pair = (word if e.word is None else e.word), (pair if e.pair is None else e.pair)
    later = 0
    for e in reversed(ends):
        extended[e.stretch] = later
        later = max(e.lead, later) if e.through else e.lead
    return opened, extended


def _filled(batches) -> list[pa.RecordBatch]:
    return [b for b in batches if b.num_rows]


def lockstep(grams: DataFrame, names: tuple[str, str, str], reverse: bool) -> DataFrame:
    """``grams`` with the columns ``names``: the count of the first word, that of the first two
    words, and of pairs the highest count among triples that begin with them (0: none). With
    ``reverse`` the words are read from the last to the first."""
    key = [F.col(f"w{j}") for j in (1, 2, 3)]
    if reverse:
        key = [F.when(F.col("size") == 3, F.col("w3")).when(F.col("size") == 2, F.col("w2"))
               .otherwise(F.col("w1")),
               F.when(F.col("size") == 3, F.col("w2")).when(F.col("size") == 2, F.col("w1"))
               .otherwise(""), F.when(F.col("size") == 3, F.col("w1")).otherwise("")]
    order = ["lang", "_k1", "_k2", "_k3"]
    parts = partitions_for(grams.sparkSession, grams.count(), ROWS_EACH)
    stream = (grams.select("*", *[k.alias(f"_k{j}") for j, k in enumerate(key, 1)])
              .repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .drop(*order[1:]).checkpoint().withColumn("stretch", F.spark_partition_id()))
    opened, extended = _ends(stream.select("stretch", "size", "f"))
    shared = grams.sparkSession.sparkContext.broadcast((opened, extended))

    def run(batches):
        batches = _filled(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        size, f = table["size"].to_numpy(), table["f"].to_numpy()
        here = table["stretch"][0].as_py()
        (word, pair), later = shared.value[0][here], shared.value[1][here]

        def latest(k, start):
            at = np.maximum.accumulate(np.where(size == k, np.arange(1, len(f) + 1), 0))
            return np.r_[start, f][at]

        longer = np.zeros(len(f), np.int64)
        shorter = np.flatnonzero(size < 3)
        if len(shorter):
            longer[shorter] = np.maximum.reduceat(np.where(size == 3, f, 0), shorter)
            longer[shorter[-1]] = max(longer[shorter[-1]], later)
        longer[size != 2] = 0
        table = table.drop_columns("stretch")
        for name, values in zip(names, (latest(1, word), latest(2, pair), longer)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.to_batches()

    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in grams.schema)
    return stream.mapInArrow(run, f"{schema}, " + ", ".join(f"{n} long" for n in names))


def collocations(docs: DataFrame, min_count: int = 10, top: int = 2000,
                 absorbed: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 and 3 words of each lang.
    A phrase scores 10^6 a^2 / (l r), rounded down, at its weakest cut; one that lies inside a
    longer candidate with at least ``absorbed`` percent of its count is left out. Columns read:
    text, lang."""
    counted = phrase_counts(docs, min_count).checkpoint()
    prefix = lockstep(counted.where("size > 0"), ("p1", "p2", "p_longer"), False)
    both = lockstep(prefix, ("s1", "s2", "s_longer"), True)

    def cut(k, left, right):
        product = [F.col(c).cast("decimal(19,0)") for c in ("f", "f", left, right)]
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)")
                                * (product[0] * product[1]).cast("decimal(31,0)"),
                                (product[2] * product[3]).cast("decimal(38,0)"))
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"),
                        F.col(left).alias("l"), F.col(right).alias("r"))

    triple = F.col("size") == 3
    weakest = F.when(triple, F.array_min(F.array(cut(1, "p1", "s2"), cut(2, "p2", "s1")))
                     ).otherwise(cut(1, "p1", "s1"))
    phrases = (both.where("size >= 2")
               .where(triple | (F.lit(100) * F.greatest("p_longer", "s_longer")
                                < F.lit(absorbed) * F.col("f")))
               .select("lang", F.rtrim(F.concat_ws(" ", "w1", "w2", "w3")).alias("phrase"),
                       F.col("f").alias("a"), weakest.alias("cut")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
        "cut.score")
