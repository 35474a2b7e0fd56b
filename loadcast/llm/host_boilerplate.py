"""Main text of web pages, with a host-wide suffix array for text that no markup explains.

Markup first sorts a page's blocks: *main* (inside an article or main element), *chrome* (menus,
page headers and footers, side columns, forms, notices, adverts, comments, scripts, styles) and
*open* (neither). Main blocks are text and chrome is none; open blocks are what the suffixes of
the host decide on, whether the page marks an article (a headline or lead before it, an article
of which only a part is marked) or not.

The words of all pages of a host outside main blocks are taken as one
set of token streams, chrome included, and their suffixes are arranged by host and first
``min_run`` words: a suffix array cut at that depth, dealt out by a shuffle instead of built in
one place. Suffixes that agree there and stand on distinct pages are repeated runs; a word is
covered if such a run starts at it or less than ``min_run`` words before it, which is what
neighbours with a long common prefix in the whole array would give. The suffixes of main blocks
are counted against them: a run that as many pages hold inside main blocks as outside is text, and
so are its words. Other covered words are boilerplate; the unique runs of open blocks stay. Pages
that agree in all main and open blocks are copies and count as one page, so that an article under
two addresses doesn't take its own text away. A page without open blocks leaves nothing to
decide: its main blocks stay, whatever its host repeats.

Defined cases: a null page counts as empty; a null or malformed URL has the empty host; rows
equal in page_id, URL and HTML are one page, so they don't repeat each other; a page without
text gives an empty string; a very long page is parsed whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_bytes

RUN_BYTES = 48          # that a run takes in a broadcast table
MAIN, CHROME, OPEN = 0, 1, 2
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)"""
                     r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)(>?)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
# fixed values: the elements and class names of HTML pages
RAW = frozenset("script style noscript template iframe textarea title object svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir "
                  "div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
                  "hgroup hr html legend li main menu nav ol option p pre section summary table "
                  "tbody td tfoot th thead tr ul".split())
CHROME_TAGS = frozenset("nav header footer aside form head menu dialog button select".split())
CHROME_NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs "
                         "comment comments cookie cookies disclaimer footer header menu modal nav "
                         "navbar navigation newsletter notice notices popup promo related respond "
                         "share sharing sidebar signup social sponsored subscribe widget".split())
CLOSED_BY_NEXT = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
                  "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
                  "th": {"td", "th", "tr"}}


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's non-empty blocks, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []          # open elements and the zone inside them
    zone, text, at = OPEN, [], 0

    def flush():
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append((zone, words))
            text.clear()

    while True:
        m = _MARKUP.search(page, at)
        text.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if not m[4]:                            # an unfinished quote or the page's end
            at = page.find(">", at) + 1 or len(page)
        if m[1]:
            if tag in BLOCK:
                flush()
            if any(t == tag for t, _ in stack):
                flush_zone = zone
                while stack.pop()[0] != tag:
                    pass
                zone = stack[-1][1] if stack else OPEN
                if zone != flush_zone and text:
                    zone, now = flush_zone, zone
                    flush()
                    zone = now
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
            while stack and tag in CLOSED_BY_NEXT.get(next(
                    (t for t, _ in reversed(stack) if t in BLOCK), ""), ()):
                while stack.pop()[0] not in CLOSED_BY_NEXT:
                    pass
            zone = stack[-1][1] if stack else OPEN
        if tag in VOID:
            continue
        inside = zone
        if zone != CHROME:
            names = _names(m[3]) if "=" in m[3] else ()
            if tag in CHROME_TAGS or any(n in CHROME_NAMES for n in names):
                inside = CHROME
            elif tag in ("article", "main") or "main" in names and "role" in m[3].lower():
                inside = MAIN
        if inside != zone and text:
            flush()
        stack.append((tag, inside))
        zone = inside
    flush()
    return out


def _names(attributes: str) -> list[str]:
    return [n for m in _ATTRIBUTE.finditer(attributes) for n in _NAME.findall(m[2].lower())]


def _key(*cols):
    return F.xxhash64(*cols)


def extract(pages: DataFrame, min_run: int = 8) -> DataFrame:
    """(page_id, url, text) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")),
                                    r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "page_key", _key("page_id", "url", "html")).withColumn("host", _key(host))

    def parsed(batches):
        for b in batches:
            texts, blocks = [], []
            for page in b.column("html"):
                found = blocks_of(page.as_py())
                undecided = any(z == OPEN for z, _ in found)
                texts.append(None if undecided else "\n".join(t for z, t in found if z == MAIN))
                blocks.append([{"zone": z, "words": t} for z, t in found] if undecided else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), b.column("page_key"),
                 pa.array(texts, pa.string()),
                 pa.array(blocks, pa.list_(pa.struct([("zone", pa.int32()),
                                                      ("words", pa.string())])))],
                ["page_id", "url", "page_key", "text", "blocks"])

    schema = rows.select("page_id", "url", "page_key",
                         F.lit(None).cast("string").alias("text"), F.expr(
                             "array(named_struct('zone', 0, 'words', ''))").alias("blocks")).schema
    sorted_blocks = rows.select("page_id", "url", "page_key", "html").mapInArrow(parsed, schema)
    decided = sorted_blocks.where("text is not null").select("page_id", "url", "text")
    undecided = sorted_blocks.where("text is null")
    covered = covered_words(rows, min_run)
    left = undecided.join(covered.withColumnRenamed("page_key", "covered_key"),
                          F.col("page_key") == F.col("covered_key"), "left")

    def unique_runs(batches):
        for b in batches:
            texts = []
            for blocks, starts, kept in zip(b.column("blocks"), b.column("starts"),
                                            b.column("texts")):
                texts.append(keep_unique([(x["zone"], x["words"]) for x in blocks.as_py()],
                                         starts.as_py() or [], min_run, kept.as_py() or []))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"])

    return decided.unionByName(left.select("page_id", "url", "blocks", "starts", "texts")
                               .mapInArrow(unique_runs, decided.schema))


def suffix_rows(rows: DataFrame, min_run: int, inside: bool = False) -> DataFrame:
    """(host, prefix, page_key, copy, start, open): every suffix of the pages' streams outside
    main blocks (or ``inside`` them) that has ``min_run`` words, by the hash of those words;
    ``open`` tells whether the run holds a word of an open block, ``copy`` is the same for pages
    that agree in all main and open blocks."""
    def run(batches):
        from xxhash import xxh3_64_intdigest
        for b in batches:
            out = []
            for page, key, host in zip(b.column("html"), b.column("page_key").to_pylist(),
                                       b.column("host").to_pylist()):
                words, is_open, found = [], [], blocks_of(page.as_py())
                text = "\n".join(f"{z} {t}" for z, t in found if z != CHROME)
                copy = xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63) \
                    if text else key
                for z, t in found:
                    if (z == MAIN) == inside:
                        w = t.split(" ")
                        words += w
                        is_open += [z == OPEN] * len(w)
                reach = np.concatenate([[0], np.cumsum(is_open)]) if words else []
                for i in range(len(words) - min_run + 1):
                    h = xxh3_64_intdigest(" ".join(words[i:i + min_run]).encode("utf-8", "replace"))
                    out.append((host, h - (1 << 63), key, copy, i,
                                bool(reach[i + min_run] > reach[i])))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (*[pa.int64()] * 4, pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["host", "prefix", "page_key", "copy", "start", "open"])
    return rows.select("html", "page_key", "host").mapInArrow(
        run, "host long, prefix long, page_key long, copy long, start int, open boolean")


def covered_words(rows: DataFrame, min_run: int) -> DataFrame:
    """(page_key, starts, texts): where runs of ``min_run`` words start that also stand on another
    page of the host, for pages whose open words they touch: ``starts`` if they stand outside main
    blocks on more pages of the host than inside, else ``texts``."""
    suffixes = suffix_rows(rows, min_run)
    repeated = (suffixes.groupBy("host", "prefix")
                .agg(F.min("copy").alias("lo"), F.max("copy").alias("hi"),
                     F.max("open").alias("any_open"))
                .where("lo != hi and any_open").select("host", "prefix").checkpoint())
    # few runs of most tables: with them in every task, no other suffix is shuffled again
    small = repeated.count() * RUN_BYTES <= broadcast_bytes(rows.sparkSession)
    runs = F.broadcast(repeated) if small else repeated
    held = suffixes.join(runs, ["host", "prefix"], "left_semi").checkpoint()
    inside = suffix_rows(rows, min_run, inside=True).join(runs, ["host", "prefix"], "left_semi")
    pages = [s.select("host", "prefix", "copy", F.lit(sign).alias("sign"))
             for s, sign in ((held, 1), (inside, -1))]
    judged = (pages[0].unionByName(pages[1]).distinct().groupBy("host", "prefix")
              .agg((F.sum("sign") > 0).alias("boilerplate")))
    start = F.col("start")
    return (held.where("open").select("host", "prefix", "page_key", "start")
            .join(judged, ["host", "prefix"]).groupBy("page_key").agg(
                F.collect_set(F.when(F.col("boilerplate"), start)).alias("starts"),
                F.collect_set(F.when(~F.col("boilerplate"), start)).alias("texts")))


def keep_unique(blocks: list[tuple[int, str]], starts: list[int], min_run: int,
                texts: list[int] = ()) -> str:
    """Main blocks, and open ones without the words that a run of ``starts`` covers and none of
    ``texts`` does."""
    covered = {i for s in starts for i in range(s, s + min_run)}
    covered -= {i for s in texts for i in range(s, s + min_run)}
    out, at = [], 0
    for zone, text in blocks:
        if zone == MAIN:                        # outside the streams
            out.append(text)
            continue
        words = text.split(" ")
        if zone == OPEN:
            kept = [w for i, w in enumerate(words, at) if i not in covered]
            if kept:
                out.append(" ".join(kept))
        at += len(words)
    return "\n".join(out)
