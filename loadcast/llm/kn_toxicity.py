"""Toxicity from class-conditional Kneser-Ney models.

Words are spelled out letter by letter, and each class, toxic and ordinary, has a Kneser-Ney model
of the next letter. In a word of ``DEPTH`` letters or fewer its context is what the word has so
far. Longer words, and text without spaces, are spelled out to their end: a letter after the
first ``DEPTH`` follows the last letters before it, as many of ``CONTEXTS`` as a class has seen
together; so does an earlier one where no class has seen the beginning of the long word. Every
letter and digit enters both likelihoods; what separates words does not, and no context reaches
from one word into the next. A class's
counts are discounted by ``CLASS_DISCOUNT``; what they lose goes to the counts of *all*
documents, labelled or not, after the same letters, which both classes share; those are
discounted in turn and back off to how many different word beginnings a letter continues. A
beginning that a class has never seen is thus smoothed alike in both and says little, while
inflected forms of an expression share their first letters. A word counts once a document, so a
text that repeats itself doesn't weigh more.

A word's log-likelihood ratio is the sum over its letters, and a long word counts as pieces of
``DEPTH`` letters; a text is judged by length-normalised ratios: the mean over all its pieces, the
highest mean over runs of 1, 2, 4, 8 and 16 pieces, and the mean over its 2, 3, 5 and 8 highest
distinct pieces. A logistic calibrator turns these and the
text's length into a score from 0 to 1.

Learning: at most about ``sample_rows`` labelled documents (a stated bound; picked by a hash of
the id) whose crc32(doc_id) mod 5 is not 0 give the class counts (remainders 1-3) and fit the
calibrator (remainder 4). The shared counts cover every document. What is broadcast holds the
word beginnings and letter runs of the sample only.

Defined cases: null and empty texts have no words and get the score of zero ratios; labels
without id or class are ignored, of several labels of one id the largest counts; a null id is
never labelled and its held_out is null; without both classes in the sample every document gets
the toxic share of the sample (0 without labels); repeated rows get equal scores; a very long text
is read whole; an empty table gives no rows; columns are kept as they are, so pass another ``name``
where the input has a column of the score's name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from heapq import nlargest
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import returning_memory, stored

DEPTH = 8
CONTEXTS = (4, 1)
FIRST, LATER = "+", "_"
CLASS_DISCOUNT, SHARED_DISCOUNT = 0.95, 0.75
WINDOWS = (1, 2, 4, 8, 16)
HIGHEST = (2, 3, 5, 8)
WORDS_KEPT = 300_000
GROUP_CHARS = 1 << 19
_LETTERS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Beginnings, of ``DEPTH`` letters at most, of the text's words in lower case."""
    return [w[:DEPTH] for w in _LETTERS.findall((text or "").lower())]


def pieces_of(text: str | None) -> list[str]:
    """The text's words in lower case, whole: a word longer than ``DEPTH`` is its first letters,
    marked ``FIRST``, and pieces of the others, marked ``LATER`` and led by the context of their
    first letter."""
    out = []
    for w in _LETTERS.findall((text or "").lower()):
        if len(w) <= DEPTH:
            out.append(w)
        else:
            out.append(FIRST + w[:DEPTH])
            out += [LATER + w[k - CONTEXTS[0]:k + DEPTH] for k in range(DEPTH, len(w), DEPTH)]
    return out


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def labelled_sample(labels: DataFrame, sample_rows: int) -> DataFrame:
    """(label_id, toxic) of about ``sample_rows`` labelled documents outside the held-out fold."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
             .where(remainder(F.col("label_id")) != 0))
    share = sample_rows / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 31)) <
                            F.lit(int(share * (1 << 31))))
    return known


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n_all, n_toxic, n_ordinary): in how many documents a piece stands, of all and of
    each class (column ``toxic``, null where unlabelled). Sums within a task come first."""
    def run(batches):
        counts = [Counter(), Counter(), Counter()]      # of all, toxic and ordinary documents

        def rows():
            words = list(counts[0])
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()),
                 *(pa.array([c.get(w, 0) for w in words], pa.int64()) for c in counts)],
                ["word", "n_all", "n_toxic", "n_ordinary"])
            for c in counts:
                c.clear()
            return out

        for batch in returning_memory(batches):
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                words, label = set(pieces_of(text.as_py())), toxic.as_py()
                counts[0].update(words)
                if label is not None:
                    counts[1 if label > 0 else 2].update(words)
                # a batch can hold many times as many
                if len(counts[0]) >= WORDS_KEPT:
                    yield rows()
        yield rows()

    return (docs.mapInArrow(run, "word string, n_all long, n_toxic long, n_ordinary long")
            .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_toxic",
                                                               "n_ordinary")]))


def step_ratios(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios (toxic over ordinary) of single letters: (key, ratio) for word
    beginnings that a class has, and for beginnings after which a class has letters, the ratio
    of any letter that neither class has there. Keys are XXH64 of the beginning. In long words
    the runs of a letter and its last ``CONTEXTS`` letters are beginnings too, led by ``LATER``."""
    n = ["n_all", "n_toxic", "n_ordinary"]
    first, later = F.col("word").startswith(FIRST), F.col("word").startswith(LATER)
    inside = [F.lit(m) for m in CONTEXTS]
    # reach 0: all that the word has so far
    reach = (F.when(later, F.array(*inside)).when(first, F.array(F.lit(0), *inside))
             .otherwise(F.array(F.lit(0))))
    lead = F.when(later, CONTEXTS[0]).otherwise(0)
    letters = F.when(first | later, F.expr("substring(word, 2)")).otherwise(F.col("word"))
    k = F.explode(F.sequence(F.greatest("reach", "lead") + 1, F.char_length("word")))
    cut = f"if(reach = 0, substring(word, 1, {{0}}), concat('{LATER}', substring(word, k - reach, {{1}})))"
    steps = (words.where("word != ''")
             .select(letters.alias("word"), lead.alias("lead"), F.explode(reach).alias("reach"), *n)
             .select("word", "reach", k.alias("k"), *n)
             .select(F.expr(cut.format("k", "reach + 1")).alias("start"),
                     F.expr(cut.format("k - 1", "reach")).alias("context"),
                     F.expr("substring(word, k, 1)").alias("letter"),
                     (F.col("reach") > 0).alias("inner"), *n)
             .groupBy("start", "context", "letter", "inner").agg(*[F.sum(c).alias(c) for c in n])
             .checkpoint())
    # two rows a character at most
    letters = steps.groupBy("inner", "letter").agg(F.count("*").alias("continues"))
    sizes = {r["inner"]: r["count"] for r in steps.groupBy("inner").count().collect()}
    total = F.when(F.col("inner"), sizes.get(True, 1)).otherwise(sizes.get(False, 1))
    contexts = steps.groupBy("context").agg(
        *[F.sum(c).alias(f"sum_{c}") for c in n],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}") for c in n])

    def discounted(c, d):
        return F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"sum_{c}")

    def left_over(c, d):
        return F.when(F.col(f"sum_{c}") > 0, d * F.col(f"kinds_{c}") / F.col(f"sum_{c}")
                      ).otherwise(1.0)

    shared = (discounted("n_all", SHARED_DISCOUNT)
              + left_over("n_all", SHARED_DISCOUNT) * F.col("continues") / total)
    p = {c: F.when(F.col(f"sum_{c}") > 0, discounted(c, CLASS_DISCOUNT)).otherwise(0.0)
         + left_over(c, CLASS_DISCOUNT) * F.col("shared") for c in n[1:]}
    known = F.col("sum_n_toxic") + F.col("sum_n_ordinary") > 0
    seen = (steps.join(contexts.where(known), "context")
            .join(F.broadcast(letters), ["inner", "letter"])
            .where("n_toxic + n_ordinary > 0").withColumn("shared", shared)
            .select(F.xxhash64("start").alias("key"),
                    F.log(p["n_toxic"] / p["n_ordinary"]).cast("float").alias("ratio")))
    unseen = contexts.where(known).select(
        F.xxhash64("context").alias("key"),
        F.log(left_over("n_toxic", CLASS_DISCOUNT) / left_over("n_ordinary", CLASS_DISCOUNT))
        .cast("float").alias("ratio"))
    return seen, unseen


class Model:
    """Step ratios in two sorted tables."""

    def __init__(self, seen, unseen):
        self.tables = []
        for keys, ratios in (seen, unseen):
            order = np.argsort(keys)
            self.tables.append((np.append(keys[order], np.iinfo(np.int64).max),
                                np.append(ratios[order], np.float32(0))))
        self.words: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "words": {}}

    def _lookup(self, table: int, keys: np.ndarray):
        stored, ratios = self.tables[table]
        at = np.searchsorted(stored[:-1], keys)
        return stored[at] == keys, ratios[at]

    def _steps(self, starts: np.ndarray, contexts: np.ndarray):
        """Ratios of the steps, and whether a class knows their contexts."""
        has, ratio = self._lookup(0, starts)
        known, other = self._lookup(1, contexts)
        return np.where(has, ratio, np.where(known, other, 0)), has | known

    def learn(self, words: list[str]) -> None:
        """Ratios of pieces that the cache lacks."""
        from xxhash import xxh64_intdigest

        def keys(strings):
            return np.array([xxh64_intdigest(s.encode("utf-8", "replace"), 42) for s in strings],
                            np.uint64).view(np.int64)

        marked = np.array([w[0] in (FIRST, LATER) for w in words])
        lead = np.array([CONTEXTS[0] if w[0] == LATER else 0 for w in words])
        letters = [w[1:] if m else w for w, m in zip(words, marked.tolist())]
        sizes = np.array([len(w) for w in letters]) - lead
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(owner)) - first[owner] + lead[owner]
        value, found = np.zeros(len(owner)), np.zeros(len(owner), bool)
        begun = np.flatnonzero(lead == 0)
        prefixes = keys(letters[i][:k] for i in begun.tolist() for k in range(sizes[i] + 1))
        is_step = np.ones(len(prefixes), bool)       # the empty beginning is a context only
        is_step[np.cumsum(sizes[begun] + 1) - sizes[begun] - 1] = False
        steps = np.flatnonzero(is_step)
        own = lead[owner] == 0
        value[own], found[own] = self._steps(prefixes[steps], prefixes[steps - 1])
        for m in CONTEXTS:
            rest = np.flatnonzero(~found & marked[owner] & (place >= m))
            runs = [LATER + letters[i][p - m:p + 1]
                    for i, p in zip(owner[rest].tolist(), place[rest].tolist())]
            value[rest], found[rest] = self._steps(keys(runs), keys(r[:-1] for r in runs))
        total = np.add.reduceat(value, first)
        if len(self.words) + len(words) > WORDS_KEPT:
            self.words.clear()
        self.words.update(zip(words, total.tolist()))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Length-normalised log-likelihood ratios of each text, and its log length."""
        split = [pieces_of(t) for t in texts]
        every = dict.fromkeys(chain.from_iterable(split))
        new = [w for w in every if w not in self.words]
        if new:
            if len(self.words) + len(new) > WORDS_KEPT:
                new = list(every)
            self.learn(new)
        get = self.words.__getitem__
        out = np.zeros((len(texts), 1 + len(WINDOWS) + len(HIGHEST) + 1))
        for i, words in enumerate(split):
            n = len(words)
            if n:
                sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(get, words), float, n))])
                out[i, 0], out[i, -1] = sums[-1] / n, np.log1p(n)
                for k, w in enumerate(WINDOWS):
                    out[i, 1 + k] = ((sums[w:] - sums[:-w]).max() if n >= w else sums[-1]) / w
                top = nlargest(HIGHEST[-1], map(get, set(words)))
                for k, w in enumerate(HIGHEST):
                    out[i, 1 + len(WINDOWS) + k] = sum(top[:w]) / w
        return out


class Calibrator:
    """Logistic regression by Newton steps, with a small penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.center, self.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = np.c_[np.ones(len(x)), (x - self.center) / self.spread]
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), 1.0)
        penalty[0] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty),
                                   z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.coefficients = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        v = self.coefficients[0] + (x - self.center) / self.spread @ self.coefficients[1:]
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _groups(texts: Iterable[pa.Scalar]):
    """Runs of texts of about ``GROUP_CHARS`` characters, so that few words are new at once and
    only one run of a batch is in strings of its own."""
    group, size = [], 0
    for text in texts:
        t = text.as_py()
        group.append(t)
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000):
    """A broadcast :class:`Model` and its :class:`Calibrator`, or the toxic share of the sample
    where it lacks a class."""
    spark = docs.sparkSession
    sample = stored(labelled_sample(labels, sample_rows), sample_rows)
    size = sample.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    share = (size[1] or 0) / max(size[0], 1)
    if size[1] in (None, 0, size[0]):
        return share
    # bounded by sample_rows
    marked = (docs.select("doc_id", "text")
              .join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left"))
    train = F.when(remainder(F.col("doc_id")) < 4, F.col("toxic").cast("int"))
    words = word_counts(marked.select("text", train.alias("toxic")))

    def pull(frame):                                # beginnings and letter runs of the sample
        table = frame.toArrow()
        return tuple(table.column(c).to_numpy() for c in ("key", "ratio"))

    model = spark.sparkContext.broadcast(Model(*map(pull, step_ratios(words))))

    def run(batches):
        for b in returning_memory(batches):
            x = [f for g in _groups(b.column("text")) for f in model.value.features(g).tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rest = marked.where((remainder(F.col("doc_id")) == 4) & F.col("toxic").isNotNull())
    rows = (rest.select("text", F.col("toxic").cast("int").alias("toxic"))
            .mapInArrow(run, "toxic int, x array<double>").collect())      # part of the sample
    y = np.array([float(r["toxic"] > 0) for r in rows])
    if len(set(y)) < 2:
        return share
    return model, Calibrator(np.array([r["x"] for r in rows]), y)


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000,
                    keep: tuple[str, ...] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (default: all) of every document and its toxicity score."""
    keep = list(docs.columns if keep is None else keep)
    fitted = fit(docs, labels, sample_rows)
    if not isinstance(fitted, tuple):
        return docs.select(*keep, F.lit(float(fitted)).alias(name))
    model, calibrator = fitted
    schema = docs.select(*keep, F.lit(0.0).alias(name)).schema
    # a kept text is sent once
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches):
        for b in returning_memory(batches):
            scores = [s for g in _groups(b.column(at))
                      for s in calibrator.scores(model.value.features(g)).tolist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(scores, pa.float64())], schema.names)

    sent = [*keep, F.col("text").alias("_llm_text")][:max(at + 1, len(keep))]
    return docs.select(*sent).mapInArrow(run, schema)
