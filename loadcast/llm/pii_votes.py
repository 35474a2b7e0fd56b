"""Personal data by weak supervision.

Exact patterns give the base spans, which always stay: e-mail addresses, IPv4 addresses, card
numbers (Luhn) and international phone numbers. Looser patterns propose more spans (written-out
e-mail addresses, IPv6, shorter and dotted card numbers, national phone numbers). Labelers vote
on every proposal, base or not: regular expressions on its shape, gazetteers (address endings,
card issuers, dialling prefixes, reserved addresses) and context (cue words before and after).
Each says yes, no, or nothing.

The votes are counted by pattern over all texts. Expectation-maximisation over these counts (a
two-class model with independent labelers, one prior per kind) estimates how reliable each
labeler is; the base patterns fix the meaning of the classes. Its posteriors train the final span
classifier, a logistic regression on votes, kind and hashed shape. Proposals it accepts, and that
touch no base span and no better proposal, join the spans.

Only counts by vote pattern and shape bucket reach the driver: at most 3^labelers x
``SHAPES`` x 4, whatever the number of texts.

Defined cases: a null text counts as empty; an empty text has no spans; offsets are code points,
end exclusive; without proposals only base spans remain; repeated rows give equal rows; a
very long text is read whole; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SHAPES = 32
CONTEXT = 40
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", re.A)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++", re.A)
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]", re.A)
_BRACKETED_AT = re.compile(r" ?[\[({](?:at|AT)[\])}] ?")
_SPOKEN_AT = re.compile(r" at (?=[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)")
_SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?| dot )"
                            r"[A-Za-z0-9-]+)+")
_PROPOSALS = {
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[ .-]{1,2}[0-9]{4,6}){2}[ .-]{1,2}[0-9]{3,5}"
                       r"(?![0-9.])|(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:(?:\+|00)[1-9][0-9]{0,2}[ .-]?)?"
                        r"(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z.-])"),
}
# fixed values: gazetteers and cue words
_ENDINGS = frozenset("com org net edu gov io co info biz de fr es uk us eu example".split())
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|client|login|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|cell|fax|telefon|t.l.phone|tel.fono)\b",
                        re.I),
}
_ANTI_CUES = re.compile(r"\b(?:version|release|order|invoice|isbn|issn|ticket|serial|page|figure|"
                        r"section|rule|table)\b[ :#.]*\Z", re.I)
LABELERS = ("exact", "shape", "gazetteer", "cue", "anti_cue", "edges")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _run_start(text: str, end: int, least: int) -> int:
    while end > least and text[end - 1] in _LOCAL:
        end -= 1
    return end


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the exact patterns by kind: leftmost, non-overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:      # the run before an @ is taken back to its start, once for each @
        start = _run_start(text, at, done)
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
               for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _loose(text: str, kind: str):
    if kind == "email":
        for at in (_BRACKETED_AT, _SPOKEN_AT) if " dot " in text else (_BRACKETED_AT,):
            for m in at.finditer(text):
                start = _run_start(text, m.start(), 0)
                d = _SPOKEN_DOMAIN.match(text, m.end()) if start < m.start() else None
                if d:
                    yield start, d.end()
    elif _DIGIT.search(text) and (kind != "ip" or text.count(":") >= 7):
        for m in _PROPOSALS[kind].finditer(text):
            if kind != "card" or luhn(_digits(m[0])):
                yield m.span()


def proposals(text: str, base: dict[str, list[tuple[int, int]]]):
    """(kind, start, end, is_base) of all candidate spans."""
    exact = sorted(span for k in KINDS for span in base[k])
    for kind in KINDS:
        yield from ((kind, s, e, True) for s, e in base[kind])
        at = 0
        for s, e in sorted(_loose(text, kind)):
            while at < len(exact) and exact[at][1] <= s:
                at += 1
            if not any(a < e and s < b for a, b in exact[at:at + 4]):
                yield kind, s, e, False


def votes(text: str, kind: str, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """One vote (1 yes, -1 no, 0 nothing) for each of ``LABELERS``."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    digits = _digits(span)
    if kind == "email":
        words = re.split(r"[^A-Za-z0-9]+", span.lower())
        shape = 1 if "@" in span or "[" in span or "(" in span or "{" in span else -1
        gazetteer = 1 if words[-1] in _ENDINGS else -1
    elif kind == "ip":
        shape = 1 if ":" in span or not re.search(r"(?:^|\.)0[0-9]", span) else -1
        gazetteer = 1 if not span.startswith(("0.", "255.", "0:")) else -1
    elif kind == "card":
        shape = 1 if len(digits) in (14, 15, 16, 19) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    else:
        shape = 1 if 9 <= len(digits) <= 13 else -1
        gazetteer = 1 if span.startswith(("+", "00", "(")) else 0
    edge = text[start - 1:start] + text[end:end + 1]
    return (1 if is_base else 0, shape, gazetteer,
            1 if _CUES[kind].search(before) or _CUES[kind].search(after) else 0,
            -1 if _ANTI_CUES.search(before) else 0,
            -1 if any(c.isalnum() for c in edge) else 1)


def shape_bucket(span: str) -> int:
    """Bucket of the span's collapsed shape: runs of letters, digits and single marks."""
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", span))
    return zlib.crc32(re.sub(r"9+", lambda m: f"9{min(len(m[0]), 6)}", shape).encode()) % SHAPES


def vote_counts(docs: DataFrame) -> DataFrame:
    """(kind, form, votes, n) over the candidate spans of all texts."""
    names = ["kind", "form", *LABELERS]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text"):
                text = t.as_py() or ""
                for kind, s, e, is_base in proposals(text, base_spans(text)):
                    rows.append((KINDS.index(kind), shape_bucket(text[s:e]),
                                 *votes(text, kind, s, e, is_base)))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], names)

    return (docs.select("text").mapInArrow(run, ", ".join(f"{n} int" for n in names))
            .groupBy(*names).agg(F.count("*").alias("n")))


def estimate(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 100):
    """Expectation-maximisation over vote patterns: posterior of *personal data* for each
    pattern, and each labeler's table P(vote | class). Tables start on the labelers' side (0.8 to
    0.2) and carry pseudo-counts; a base vote is taken as certain."""
    m = v.shape[1]
    start = {1: (0.2, 0.8), 0: (0.5, 0.5), -1: (0.8, 0.2)}
    table = np.array([[[start[x][c] for x in (-1, 0, 1)] for _ in range(m)] for c in (0, 1)])
    table /= table.sum(axis=2, keepdims=True)
    prior = np.full(len(KINDS), 0.5)
    post = np.full(len(v), 0.5)
    for _ in range(rounds):
        log = [np.log(table[c][np.arange(m), v + 1]).sum(axis=1)
               + np.log(prior[kind] if c else 1 - prior[kind]) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        new = np.where(v[:, 0] == 1, 1.0, new)
        moved = np.abs(new - post).max(initial=0)
        post = new
        for c, w in ((1, post * n), (0, (1 - post) * n)):
            for j in range(1, m):
                counts = np.bincount(v[:, j] + 1, weights=w, minlength=3)
                pseudo = 5 * np.array([start[x][c] for x in (-1, 0, 1)])
                table[c][j] = (counts + pseudo) / (counts + pseudo).sum()
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = np.clip(((post * n)[own].sum() + 1) / (n[own].sum() + 2), 1e-3, 1 - 1e-3)
        if moved < 1e-6:
            break
    return post, table


def _design(kind: np.ndarray, shape: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Features of the classifier: kind, kind and vote, shape bucket. Not whether the exact
    pattern matched, so that it learns what such spans look like."""
    k = np.eye(len(KINDS))[kind]
    votes_ = v[:, 1:].astype(float)
    return np.hstack([k, votes_, np.eye(SHAPES)[shape]])


def train(kind: np.ndarray, shape: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the span classifier, fitted to the estimated posteriors."""
    post, _ = estimate(kind, v, n)
    x = _design(kind, shape, v)
    w = np.zeros(x.shape[1])
    weight = n / max(n.sum(), 1) * min(n.sum(), 1e6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)),
                               x.T @ (weight * (post - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find_spans(text: str, weights: np.ndarray | None):
    """Base spans, and all spans including those that the classifier adds, both by kind."""
    base = base_spans(text)
    spans = {k: list(s) for k, s in base.items()}
    if weights is not None:
        more = []
        for kind, s, e, is_base in proposals(text, base):
            if not is_base:
                v = np.array([votes(text, kind, s, e, False)])
                z = float((_design(np.array([KINDS.index(kind)]),
                                   np.array([shape_bucket(text[s:e])]), v) @ weights)[0])
                if z >= 0:
                    more.append((-z, s, e, kind))
        taken: list[tuple[int, int]] = []
        for _, s, e, kind in sorted(more):
            i = bisect.bisect(taken, (s, e))
            if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                taken.insert(i, (s, e))
                spans[kind].append((s, e))
    return base, {k: sorted(s) for k, s in spans.items()}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def fit(docs: DataFrame) -> np.ndarray | None:
    """The classifier's weights from the votes over all texts; None without proposals."""
    rows = vote_counts(docs).collect()              # bounded by labelers, shapes and kinds
    if not any(r["exact"] != 1 for r in rows):
        return None
    rows.sort()
    a = np.array([tuple(r) for r in rows], dtype=np.int64)
    return train(a[:, 0], a[:, 1], a[:, 2:-1], a[:, -1].astype(float))


def annotate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    weights = fit(docs)
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text"):
                base, spans = find_spans(t.as_py() or "", weights)
                rows.append((*(len(base[k]) for k in KINDS),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]),
                 *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", *counts, "base_sha256", "spans"])

    schema = docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in counts],
                         F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans are
    replaced together, by the kind of the first. A null text stays null."""
    weights = fit(docs)

    def clean(text):
        _, spans = find_spans(text, weights)
        out, at = [], 0
        for s, e, kind in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
            if s >= at:
                out += [text[at:s], f"<{kind}>"]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clean(t))

    return docs.withColumn("text", run("text"))
