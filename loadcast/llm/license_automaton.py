"""Licence scans with a generalised suffix automaton of licence words.

The words of all templates form one suffix automaton: a state stands for the word runs that end at
the same places of the templates. A text is streamed through it once; at each word the automaton
gives the longest run ending there that stands in some template (the matching statistics). A
match that the next word does not continue is an anchor if it has ``ANCHOR`` words or more. The
anchors of a template are chained in order, in the text as in the template, over gaps of at most
``GAP`` words; a chain that covers a share of ``COVER`` of the template's words is a span. Where
spans overlap, the one that covers more words stays. A chain looks back as far as a gap allows, so
the work grows with the text and not with its square.

Phrases that name a licence by themselves are runs of the automaton as well: a phrase stands
wherever the matched run ends with it.

The templates are a parameter and travel to the tasks; they must hold at most ``MAX_WORDS`` words.

Defined cases: a null text is empty and has no words, places or spans; repeated rows get equal
results; a null doc_id is kept; a very long text is streamed whole; an empty table gives an empty
result; all columns are kept, and those of the result named in ``RESULT`` replace columns of the
same names.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import NOTICES, PHRASES

ANCHOR = 3
GAP = 12
COVER = 0.75
MAX_WORDS = 1_000_000
RESULT = ("n_words", "places", "spans")
_PLACES = "array<struct<label:string,start:int>>"
_SPANS = "array<struct<label:string,start:int,stop:int,covered:int,share:double>>"
#: ASCII letters in lower case, digits and all bytes of other characters; the rest separates
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127
                    else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences. ``next``: word -> state, ``link``: the state
    of the longest shorter run with more places, ``length``: the longest run of the state."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: state -> (sequence, position of the last word), of states with runs of ANCHOR words
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(sequences):
            state = 0
            for at, word in enumerate(words):
                state = above = self.next[state][word]
                while self.length[above] >= ANCHOR:
                    self.places[above].append((k, at))
                    above = self.link[above]

    def _state(self, length: int, steps: dict[bytes, int], link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state of the run that ``word`` makes of ``state``'s longest run."""
        far = self.next[state][word]
        if self.length[far] == self.length[state] + 1:
            return far
        near = self._state(self.length[state] + 1, dict(self.next[far]), self.link[far])
        self.link[far] = near
        while state >= 0 and self.next[state].get(word) == far:
            self.next[state][word] = near
            state = self.link[state]
        return near

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:      # an earlier sequence has this run
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def state_of(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state

    def stream(self, words: list[bytes]):
        """(position, state, run length) of every word that ends a run of the sequences."""
        state, run = 0, 0
        for at, word in enumerate(words):
            steps = self.next[state]
            while word not in steps and state:
                state = self.link[state]
                run = self.length[state]
                steps = self.next[state]
            if word in steps:
                state, run = steps[word], run + 1
                yield at, state, run


class Scanner:
    """Templates and phrases, ready to scan."""

    def __init__(self, templates, phrases):
        self.labels = [label for label, _ in templates]
        self.sequences = [words_of(text.encode()) for _, text in templates]
        if sum(map(len, self.sequences)) > MAX_WORDS:
            raise ValueError(f"licence templates hold more than {MAX_WORDS} words")
        named = [(words_of(phrase.encode()), label) for phrase, label in phrases]
        self.automaton = Automaton(self.sequences + [words for words, _ in named])
        #: state -> phrases its runs end with, if they are long enough
        ends = {}
        for words, label in named:
            ends.setdefault(self.automaton.state_of(words), []).append((len(words), label))
        self.phrases = []
        for state in range(len(self.automaton.next)):
            own = []
            above = state
            while above > 0:
                own += ends.get(above, [])
                above = self.automaton.link[above]
            self.phrases.append(own)
        self.words = frozenset(w for steps in self.automaton.next for w in steps)

    def scan(self, words: list[bytes]):
        """Places (label, start) of phrases and spans (label, start, stop, covered, share)."""
        places, anchors = [], []
        held = (-2, 0, 0)
        for at, state, run in self.automaton.stream(words):
            for length, label in self.phrases[state]:
                if run >= length:
                    places.append((label, at + 1 - length))
            if held[2] >= ANCHOR and not (at == held[0] + 1 and run == held[2] + 1):
                anchors.append(held)
            held = (at, state, run)
        if held[2] >= ANCHOR:
            anchors.append(held)
        return places, self._spans(anchors) if anchors else []

    def _spans(self, anchors):
        by_template = defaultdict(list)
        for at, state, run in anchors:
            for k, end in self.automaton.places[state]:
                # the first sequences are the templates, phrases come after them
                if k < len(self.sequences) and end - run + 1 >= 0:
                    by_template[k].append((at, end, run))
        found = []
        for k, own in by_template.items():
            needed = COVER * len(self.sequences[k])
            for start, stop, covered in _chains(own):
                if covered >= needed:
                    found.append((covered, start, stop, self.labels[k],
                                  covered / len(self.sequences[k])))
        found.sort(key=lambda s: (-s[0], -s[4], s[1], s[3]))
        taken = _Taken()
        return [(label, start, stop, covered, share)
                for covered, start, stop, label, share in found if taken.add(start, stop)]


class _Taken:
    """Intervals that don't overlap, by their last word."""

    def __init__(self):
        self.words: set[int] = set()

    def add(self, start: int, stop: int) -> bool:
        if not self.words.isdisjoint(range(start, stop + 1)):
            return False
        self.words.update(range(start, stop + 1))
        return True


def _chains(anchors):
    """(start, stop, covered) of chains of one template's anchors (last word in the text, last
    word in the template, length), the heaviest chain to each chain's end."""
    covered, start, used, heads = [], [], [False] * len(anchors), []
    anchors = sorted(anchors)
    for j, (at, end, run) in enumerate(anchors):
        best, before = run, -1
        for i in range(j - 1, -1, -1):
            at_i, end_i, run_i = anchors[i]
            if at_i < at - run - GAP:
                break
            if at_i >= at or at_i - run_i >= at - run or end_i >= end or \
                    end_i - run_i >= end - run or end - run - end_i > GAP:
                continue
            fresh = min(at - max(at_i, at - run), end - max(end_i, end - run))
            if covered[i] + fresh > best:
                best, before = covered[i] + fresh, i
        covered.append(best)
        start.append(at - run + 1 if before < 0 else start[before])
        if before >= 0:
            used[before] = True
        heads.append(before)
    return [(start[j], anchors[j][0], covered[j]) for j in range(len(anchors)) if not used[j]]


def scan(docs: DataFrame, templates=NOTICES, phrases=PHRASES, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (label and first word of each phrase) and ``spans``
    (label, first and last word, covered words of the template, their share)."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases))
    kept = [c for c in docs.columns if c not in RESULT]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_llm_text"))

    def run(batches):
        scanner = shared.value
        known = scanner.words
        place_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()),
                                        ("stop", pa.int32()), ("covered", pa.int32()),
                                        ("share", pa.float64())]))
        for batch in batches:
            n_words, places, spans = [], [], []
            for value in batch.column("_llm_text").cast(pa.large_binary()):
                words = words_of(value.as_py())
                n_words.append(len(words))
                own = ([], []) if known.isdisjoint(words) else scanner.scan(words)
                places.append([{"label": p, "start": s} for p, s in own[0]])
                spans.append([dict(zip(("label", "start", "stop", "covered", "share"), s))
                              for s in own[1]])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(kept))], pa.array(n_words, pa.int64()),
                 pa.array(places, place_type), pa.array(spans, span_type)],
                [*kept, *RESULT])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.mapInArrow(run, f"{fields}n_words long, places {_PLACES}, spans {_SPANS}")


def digest() -> list:
    """Columns n_words to score of a scanned table: counts and first and last place of phrases,
    labels of the phrases, labels of all, and the highest share of a template that is covered
    (a phrase is covered whole)."""
    def joined(labels):
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    n = F.size("places")
    score = F.greatest(F.coalesce(F.array_max("spans.share"), F.lit(0.0)),
                       F.when(n > 0, 1.0).otherwise(0.0))
    return [F.col("n_words"), n.cast("long").alias("n_base"),
            F.array_min("places.start").cast("long").alias("first_word"),
            F.array_max("places.start").cast("long").alias("last_word"),
            joined(F.col("places.label")).alias("base_labels"),
            joined(F.concat("places.label", "spans.label")).alias("labels"),
            F.least(score, F.lit(1.0)).alias("score")]
