"""Sum-of-squares online packing of token windows.

A document's ids (the tokenizer's, then an end id) are cut into whole windows of ``size`` ids and
one rest. The rest goes, in the order the documents come, to the open window whose fill level
leaves the sum of squared counts of partially filled windows smallest; the counts stand in one
array by level, an empty window is level 0, and ties go to the fuller window. When a block of
documents ends, the windows still open are closed: their pieces are cut so that whole windows
come first, and what is left is split into sequences of power-of-two length. So no sequence is
padded and few documents are cut.

A block is one partition of the input. Blocks are packed independently, on the executors, with
no shuffle: a block holds its open windows only, and sequence ids carry the partition's number.
The same files read with the same split size give the same sequences; an executor that is lost
has its partitions packed again with the same result.

Ids come from a table of distinct white-space-delimited words, each encoded once: the tokenizer
drops white space and never merges over it. Texts with separators that Python and the tokenizer
may class differently are encoded whole.

Defined cases: a null text counts as empty; an empty text has the end id only; repeated rows are
packed one by one; a very long text is cut into pieces that cover it; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning_memory

TABLE_WORDS = 800_000
LONG_WORD = 256
#: white space and controls that Python and the tokenizer may class differently
_UNSURE = re.compile("[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029"
                     "\u202f\u205f\u2060\u3000\ufeff]")
#: the tokenizer's pattern, for texts without the characters of _OTHER_TEXT
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_OTHER_TEXT = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00ff]|<[|]")
#: byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(
    b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class WordIds:
    """Ids, little-endian unsigned 32-bit, of texts by their white-space-delimited words.

    A text of ASCII and Latin-1 letters is put in lower case, as the tokenizer does; its words are
    split by the tokenizer's own pattern and each part is merged once by the tokenizer's model.
    Words of any other text go through the whole library.
    """

    def __init__(self, tokenizer_path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.path = tokenizer_path
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}        # plain words in lower case
        self.others: dict[str, bytes] = {}       # words of other texts as they stand
        sample = "It's PLAIN text_1, d\u00e9j\u00e0 vu: x=42!!'tis \u00dcber\u00df"
        self.by_part = b"".join(map(self.split, sample.lower().split())) == self.whole(sample)

    def __reduce__(self):
        return WordIds, (self.path,)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merge(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def split(self, word: str) -> bytes:
        return b"".join([_known(self.parts, p, self.merge) for p in _PARTS.findall(word)])

    def encode(self, text: str) -> bytes:
        if self.by_part and not _OTHER_TEXT.search(text):
            table, words, make = self.words, text.lower().split(), self.split
        elif _UNSURE.search(text):
            return self.whole(text)
        else:
            table, words, make = self.others, text.split(), self.whole
        try:
            return b"".join([table[w] for w in words])
        except KeyError:
            return b"".join([table[w] if w in table else _known(table, w, make) for w in words])


def _known(table: dict[str, bytes], word: str, make) -> bytes:
    ids = table.get(word)
    if ids is None:
        ids = make(word)
        if len(word) <= LONG_WORD:
            if len(table) >= TABLE_WORDS:
                table.clear()
            table[word] = ids
    return ids


def word_ids(tokenizer_path: str) -> WordIds:
    return WordIds(tokenizer_path)


class LevelPacker:
    """Places rests online. ``place`` and ``close`` return finished sequences, each a list of
    (key, start, ids) in order."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size, np.int64)            # open windows at each level
        self.open: dict[int, list[list]] = {}             # level -> windows (lists of pieces)
        self.levels = np.arange(size)

    def level_for(self, length: int) -> int:
        """Level to place ``length`` ids at. Moving a window from level h to h + length changes
        the sum of squares by 2 (count[h + length] - count[h]) + 2; opening one at 0 by
        2 count[length] + 1; filling one up by 1 - 2 count[h]."""
        room = self.size - length
        cost = np.empty(room + 1, np.int64)
        cost[0] = 2 * self.counts[length] + 1
        if room:
            cost[1:room] = 2 * (self.counts[length + 1:] - self.counts[1:room]) + 2
            cost[room] = 1 - 2 * self.counts[room]
            cost[1:][self.counts[1:room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(cost[::-1]))

    def place(self, key, start: int, ids) -> list | None:
        length = len(ids)
        level = self.level_for(length)
        if level:
            windows = self.open[level]
            window = windows.pop()
            if not windows:
                del self.open[level]
            self.counts[level] -= 1
        else:
            window = []
        window.append((key, start, ids))
        if level + length == self.size:
            return window
        self.counts[level + length] += 1
        self.open.setdefault(level + length, []).append(window)
        return None

    def close(self):
        """Sequences of what is open: fuller windows first, cut to whole windows, the rest to
        powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True)
                  for window in self.open[level] for p in window]
        self.open.clear()
        self.counts[:] = 0
        left = sum(len(p[2]) for p in pieces)
        sequence, room = [], 0
        for key, start, ids in pieces:
            while len(ids):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                take = min(room, len(ids))
                sequence.append((key, start, ids[:take]))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    yield sequence
                    sequence = []


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the ids themselves where ``with_ids`` is set."""
    end = np.array([end_id], dtype="<u4").tobytes()
    if size & (size - 1):
        raise ValueError("the window must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # a worker's tables go when it turns to tasks without this broadcast
    shared = docs.sparkSession.sparkContext.broadcast(word_ids(tokenizer_path))

    def run(batches):
        from pyspark import TaskContext
        table, packer = shared.value, LevelPacker(size)
        next_id = TaskContext.get().partitionId() << 33
        kind = None
        rows: list[tuple] = []

        def emit(sequence):
            nonlocal next_id
            offset = 0
            for (doc, total), start, ids in sequence:
                raw = ids.tobytes()
                row = (doc, start, len(ids), zlib.crc32(raw), total, next_id, offset)
                rows.append(row + (ids.astype(np.int32).tolist(),) if with_ids else row)
                offset += len(ids)
            next_id += 1

        def batch():
            cols = list(zip(*rows)) or [[]] * (len(names) + with_ids)
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for b in returning_memory(batches):
            kind = b.schema.field("doc_id").type
            for doc, text in zip(b.column("doc_id"), b.column("text")):
                ids = np.frombuffer(table.encode(text.as_py() or "") + end, dtype="<u4")
                key = (doc.as_py(), len(ids))
                whole = len(ids) // size * size
                for at in range(0, whole, size):
                    emit([(key, at, ids[at:at + size])])
                if whole < len(ids):
                    # a copy, so that an open window doesn't hold the whole document
                    if full := packer.place(key, whole, ids[whole:].copy()):
                        emit(full)
            yield batch()
        if kind is not None:
            for sequence in packer.close():
                emit(sequence)
            yield batch()

    kinds = [F.lit(0).cast("long").alias(n) for n in names[1:]]
    if with_ids:
        kinds.append(F.array(F.lit(0)).alias("ids"))
    schema = docs.select("doc_id", *kinds).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)
