"""SentencePiece encoding and decoding over a table of distinct marked words.

Where no piece of the model has a white-space marker after another character, no merge crosses
the start of a marked word (a run of markers and the characters up to the next one). Each
distinct marked word is then segmented once and a text's ids are its words' ids, joined by
position; decoding joins the words' decoded forms likewise. The table lives in the task that
reads the texts, so no text or word is shuffled; it is emptied when it is full, which costs time
but changes no result. Words longer than ``LONG_WORD`` leave it with their group of texts.

Models that don't meet the condition, or that change texts before they split them, are refused.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty
text; repeated rows give equal rows; a very long text or word is segmented whole; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_WORDS = 400_000
LONG_WORD = 256
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: texts that a model without a normaliser leaves as they are
_PROBES = (" a  b ", "ﬁ①Ａ", "é é", "\t\n\r\x00x", "a　b c")


class WordTable(dict):
    """Marked word without its first marker -> its ids as decimal text, comma-joined."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m = self.model
        if any(MARK in m.id_to_piece(i).lstrip(MARK) for i in range(m.get_piece_size())):
            raise ValueError("a piece crosses a white-space marker")
        if any(m.decode(m.encode(t)) != t for t in _PROBES) or m.encode("") \
                or m.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("the model changes texts before it splits them")
        self.mark_id = m.piece_to_id(MARK)
        self.odd: dict[str, str] = {}   # words that don't decode to themselves

    def learn(self, words: list[str]) -> None:
        """Segment and decode words that the table lacks, in one call of the library each."""
        if len(self) + len(words) > TABLE_WORDS:
            self.clear()
            self.odd.clear()
        ids = self.model.encode(words, num_threads=1)
        ids = [x if w else [self.mark_id] for w, x in zip(words, ids)]
        self.update(zip(words, [repr(x)[1:-1].replace(" ", "") for x in ids]))
        plain = self.model.decode(ids, num_threads=1)
        if plain != words:
            self.odd.update((w, p) for w, p in zip(words, plain) if p != w.replace(MARK, " "))

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids as comma-joined decimals, and the text that they decode to."""
        split = [marked_words(t) for t in texts]
        new = dict.fromkeys(chain.from_iterable(split))
        new = [w for w in new if w not in self]
        if new:
            if len(self) + len(new) > TABLE_WORDS:
                new = list(dict.fromkeys(chain.from_iterable(split)))
            self.learn(new)
        get = self.__getitem__
        out = []
        for text, words in zip(texts, split):
            if self.odd:
                plain = " ".join([self.odd.get(w, w) for w in words])
            else:
                plain = text
            out.append((",".join(map(get, words)), plain.replace(MARK, " ")))
        for w in [w for w in new if len(w) > LONG_WORD]:
            del self[w]
            self.odd.pop(w, None)
        return out


def marked_words(text: str) -> list[str]:
    """The text's marked words, each without its first marker."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _MARKED.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def in_groups(texts: list[str], chars: int = 1 << 20):
    """Runs of texts of about so many characters in all."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


_TABLES: dict[str, WordTable] = {}


def word_table(model_path: str) -> WordTable:
    if model_path not in _TABLES:
        _TABLES[model_path] = WordTable(model_path)
    return _TABLES[model_path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every document."""
    def run(batches):
        table = word_table(model_path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            done = [x for group in in_groups(texts) for x in table.encode(group)]
            ids = [[int(i) for i in x.split(",")] if x else [] for x, _ in done]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([d for _, d in done], pa.string())], ["doc_id", "ids", "decoded"])

    schema = docs.select("doc_id", F.array(F.lit(0)).alias("ids"),
                         F.lit("").alias("decoded")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, without building the
    id arrays outside the task."""
    def digest(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8")).hexdigest()

    def run(batches):
        table = word_table(model_path)
        for b in batches:
            n, ids, decoded = [], [], []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for group in in_groups(texts):
                for x, d in table.encode(group):
                    n.append(x.count(",") + 1 if x else 0)
                    ids.append(digest(x))
                    decoded.append(digest(d))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"),
                         F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_ids(ids: Column, model_path: str) -> Column:
    """Texts of arrays of ids, by the library."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        model = word_table(model_path).model
        return x.map(lambda v: None if v is None else model.decode([int(i) for i in v]))
    return run(ids)
