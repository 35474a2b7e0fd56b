"""Lexical search, collocations and licence scans, held against plain Python over small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loadcast.llm import collocation_streams, license_automaton, stratified_search
from loadcast.llm.licence_texts import NOTICES, PHRASES

COLUMNS = ("doc_id long, text string, lang string, m long, terms string, block string, "
           "stretch string, f string, size string, places string, n_words string, `a b` string")


def documents(spark, texts, langs=("en", "de", None), ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, langs[k % len(langs)], None, *["x"] * 8)
         for k, (i, t) in enumerate(zip(ids, texts))], COLUMNS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sample_texts(n=150, seed=5, vocabulary=40):
    rng = random.Random(seed)
    words = ["the", "of", "É1", "naïve", "日本", "x y", "a", "_", "Zed", "it's", "\x01low"]
    words += ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
              for _ in range(vocabulary)]
    out = [None, "", " \t ", "...", "one", "ONE one", "q" * 3000, "the of " * 8000]
    for _ in range(n):
        picked = [words[min(int(rng.expovariate(0.15)), len(words) - 1)]
                  for _ in range(rng.randint(1, 60))]
        out.append("".join(w + rng.choice([" ", " ", " ", " ", "\t", ". ", ",", "\n", "\r"])
                           for w in picked))
    return out + out[8:14] + [out[9]] * 5


# ------------------------------------------------------------------------------ op11
def ranked_by_hand(rows, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(i, Counter(pattern.findall(lower(t)))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    total, docs = sum(sum(c.values()) for _, c in counts), len(counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = set(pattern.findall(lower(text)))
        scored = []
        for doc_id, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * docs // total
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in
                enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()),
                  key=str)


@pytest.fixture(scope="module")
def searched(spark):
    texts = sample_texts()
    ids = [None if k == 20 else 3 if k in (30, 31) else 1000 - k for k in range(len(texts))]
    items = [(1, texts[10]), (2, "the ONE naïve 日本"), (3, None), (4, "..."), (5, "nowhere"),
             (6, texts[9]), (6, texts[9]), (None, "of the")]
    return (list(zip(ids, texts)), documents(spark, texts, ids=ids), items,
            spark.createDataFrame(items, "item_id int, text string"))


@pytest.mark.parametrize("k", [3, 50])
def test_rank_equals_brute_force(searched, k):
    rows, docs, items, asked = searched
    assert found(stratified_search.rank(docs, asked, k)) == \
        ranked_by_hand(rows, list(dict.fromkeys(items)), k)


def test_rank_in_small_blocks_and_query_parts(searched, monkeypatch):
    monkeypatch.setattr(stratified_search, "BLOCK_DOCS", 3)
    monkeypatch.setattr(stratified_search, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(stratified_search, "TERMS_KEPT", 50)
    monkeypatch.setattr(stratified_search, "QUERY_BYTES", 100)
    rows, docs, items, asked = searched
    assert found(stratified_search.rank(docs, asked, 7)) == \
        ranked_by_hand(rows, list(dict.fromkeys(items)), 7)


def test_search_in_a_stored_index(spark, searched, tmpdir_path):
    rows, docs, items, asked = searched
    stratified_search.build_index(docs).save(tmpdir_path + "/index")
    index = stratified_search.Index.load(spark, tmpdir_path + "/index")
    assert found(stratified_search.search(index, asked, 10)) == \
        ranked_by_hand(rows, list(dict.fromkeys(items)), 10)


def test_strata_under_the_threshold_are_skipped(spark):
    """Documents of one word each are far behind long ones that hold every term of the query."""
    texts = ["alpha beta gamma " * (k + 2) for k in range(30)] + ["alpha"] * 300
    docs = documents(spark, texts)
    index = stratified_search.build_index(docs)
    queries, _ = next(stratified_search._query_blocks(
        spark.createDataFrame([(1, "alpha beta gamma")], "item_id int, text string")))
    queries.weights = stratified_search._weights(index, queries.vocabulary)
    least = stratified_search._thresholds(index, spark.sparkContext.broadcast(queries), 1)
    bounds = {r["m"]: stratified_search._Visit({c: b.column(c)[0] for c in b.schema.names},
                                               queries).bounds[0]
              for b in index.blocks.toArrow().to_batches(max_chunksize=1)
              for r in b.select(["m"]).to_pylist()}
    assert bounds[min(bounds)] < least[0] <= max(bounds.values())


def test_rank_without_documents_or_queries(spark, searched):
    _, docs, _, asked = searched
    assert stratified_search.rank(docs.limit(0), asked).count() == 0
    assert stratified_search.rank(docs, asked.limit(0)).count() == 0
    assert stratified_search.rank(documents(spark, [None, ""]), asked).count() == 0


# ------------------------------------------------------------------------------ op12
def counts_by_hand(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i:i + size])] += 1
    return f, n


def collocations_by_hand(rows, min_count, top):
    f, n = counts_by_hand(rows)
    out = []
    for lang in f:
        found = []
        long = {g: a for g, a in f[lang].items() if len(g) == 3 and a >= min_count}
        for g, a in f[lang].items():
            if len(g) == 1 or a < min_count:
                continue
            if len(g) == 2 and any(100 * b >= 50 * a for h, b in long.items()
                                   if g in (h[:2], h[1:])):
                continue
            cuts = [(10 ** 6 * a * a // (f[lang][g[:k]] * f[lang][g[k:]]), k)
                    for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), f[lang][g[:k]], f[lang][g[k:]]))
        out += [(lang, r, p.decode(), -a, l, r2, n[lang], -s)
                for r, (s, a, p, l, r2) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n",
                                              "score").collect())


@pytest.fixture(scope="module")
def phrases(spark):
    texts = sample_texts(200, seed=8, vocabulary=12)
    langs = ("en", "de", None, "und", "en")
    return [(langs[k % 5], t) for k, t in enumerate(texts)], documents(spark, texts, langs)


@pytest.mark.parametrize("top", [2000, 5])
def test_collocations_equal_brute_force(phrases, top):
    rows, docs = phrases
    by_hand = collocations_by_hand(rows, 10, top)
    assert len(by_hand) > 10
    assert mined(collocation_streams.collocations(docs, top=top)) == by_hand


@pytest.mark.parametrize("chunk, stretch, rows_each", [(7, 100, 4), (3, 30, 1), (1000, 10, 7)])
def test_collocations_in_small_pieces(phrases, monkeypatch, chunk, stretch, rows_each):
    """Runs, pairs and words that reach over chunks, stretches and walks."""
    monkeypatch.setattr(collocation_streams, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(collocation_streams, "STRETCH_TOKENS", stretch)
    monkeypatch.setattr(collocation_streams, "ROWS_EACH", rows_each)
    monkeypatch.setattr(collocation_streams, "partitions_for",
                        lambda spark, rows, each: min(40, max(1, -(-rows // each))))
    rows = [(k, t[:300] if t else t) for k, t in phrases[0]]
    docs = documents(phrases[1].sparkSession, [t for _, t in rows],
                     ("en", "de", None, "und", "en"))
    assert mined(collocation_streams.collocations(docs, min_count=4)) == \
        collocations_by_hand(rows, 4, 2000)


def test_phrase_counts_equal_brute_force(phrases):
    rows, docs = phrases
    f, n = counts_by_hand(rows)
    got = {(r["lang"], r["size"], *[w for w in (r["w1"], r["w2"], r["w3"]) if w]): r["f"]
           for r in collocation_streams.phrase_counts(docs, 10).collect()}
    want = {(lang, len(g), *g): a for lang in f for g, a in f[lang].items() if a >= 10}
    assert got == want | {(lang, 0): n[lang] for lang in n}


def test_collocations_of_a_pair_in_a_third_of_all_words(spark):
    rng = random.Random(2)
    rows = [("en", " ".join(f"new york w{rng.randint(0, 300)}" for _ in range(40)))
            for _ in range(60)]
    docs = documents(spark, [t for _, t in rows], ("en",))
    assert mined(collocation_streams.collocations(docs, min_count=5)) == \
        collocations_by_hand(rows, 5, 2000)


def test_collocations_without_phrases(spark, phrases):
    _, docs = phrases
    assert collocation_streams.collocations(docs.limit(0)).count() == 0
    assert collocation_streams.collocations(documents(spark, [None, "", "a b"])).count() == 0


def test_scores_past_64_bits(spark):
    """Products of counts are taken in decimals."""
    big = 4 * 10 ** 12
    grams = spark.createDataFrame(
        [("en", 1, "a", "", "", big), ("en", 1, "b", "", "", big + 1),
         ("en", 2, "a", "b", "", big - 7), ("en", 0, "", "", "", 3 * big)],
        "lang string, size int, w1 string, w2 string, w3 string, f long")
    original = collocation_streams.phrase_counts
    collocation_streams.phrase_counts = lambda docs, least: grams
    try:
        row, = mined(collocation_streams.collocations(grams))
    finally:
        collocation_streams.phrase_counts = original
    a = big - 7
    assert row == ("en", 1, "a b", a, big, big + 1, 3 * big, 10 ** 6 * a * a // (big * (big + 1)))


# ------------------------------------------------------------------------------ op13
def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def licence_texts():
    rng = random.Random(4)
    words = ["the", "of", "license", "mit", "general", "public", "apache", "software", "É", "x9"]
    out = [None, "", "...", "MIT License", "the mit license mit license",
           "GNU General Public License", "general public apache license", "mit\nLICENSE",
           "mıt license", "license " * 20_000, "mit license " * 3000]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    for label, notice in NOTICES:
        out.append("lorem ipsum. " + notice + " dolor sit amet")
    return out + out[40:44]


def longest_runs(words, sequences):
    """By hand: for each place the longest run ending there that stands in some sequence."""
    stand = {tuple(s[i:j]) for s in sequences for i in range(len(s))
             for j in range(i + 1, len(s) + 1)}
    out = {}
    for at in range(len(words)):
        run = 0
        for n in range(1, at + 2):
            if tuple(words[at + 1 - n:at + 1]) not in stand:
                break
            run = n
        if run:
            out[at] = run
    return out


def test_matching_statistics_equal_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        sequences = [[rng.choice("abc") for _ in range(rng.randint(1, 9))]
                     for _ in range(rng.randint(1, 4))]
        automaton = license_automaton.Automaton(sequences)
        words = [rng.choice("abcd") for _ in range(40)]
        assert {at: run for at, _, run in automaton.stream(words)} == \
            longest_runs(words, sequences)
        for at, state, run in automaton.stream(words):
            if run >= license_automaton.ANCHOR:
                places = {(k, e) for k, s in enumerate(sequences) for e in range(run - 1, len(s))
                          if s[e + 1 - run:e + 1] == words[at + 1 - run:at + 1]}
                assert set(automaton.places[state]) == places


def test_phrases_equal_brute_force(spark):
    texts = licence_texts()
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in license_automaton.scan(docs).select(
        "doc_id", "text", "`a b`", *license_automaton.digest()).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        words = licence_words(text)
        at = [(i, label) for phrase, label in PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["text"], r["a b"]) == (len(words), len(at), text, "x")
        assert (r["first_word"], r["last_word"]) == \
            ((min(at)[0], max(at)[0]) if at else (None, None))
        base = sorted({label for _, label in at})
        assert r["base_labels"] == ",".join(base)
        assert set(base) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_whole_and_changed_notices_are_found(spark):
    texts, want = [], []
    for label, notice in NOTICES:
        words = notice.split()
        for changes in (False, True):           # every 15th word is another one
            if changes and len(words) < 30:
                continue
            changed = ["blah" if changes and i % 15 == 7 else w for i, w in enumerate(words)]
            texts.append("foo bar " * 5 + " ".join(changed) + " baz" * 7)
            want.append((label, 10, changes))
        if len(words) >= 30:                    # a third of a notice is not the notice
            texts.append(" ".join(words[:len(words) // 3]))
            want.append((None, 0, 0))
    for row, (label, start, changes) in zip(
            license_automaton.scan(documents(spark, texts)).orderBy("doc_id").collect(), want):
        if label is None:
            assert not row["spans"]
            continue
        best = row["spans"][0]
        assert best["label"] == label and abs(best["start"] - start) <= 3
        if not changes:
            assert best["share"] == 1 and best["covered"] == best["stop"] - start + 1


def test_two_notices_in_a_text_and_many_in_another(spark):
    apache = next(t for label, t in NOTICES if label == "apache")
    bsd = next(t for label, t in NOTICES if label == "bsd")
    rows = license_automaton.scan(documents(spark, [apache + " and " + bsd, (bsd + " ") * 400])
                                  ).orderBy("doc_id").collect()
    assert {s["label"] for s in rows[0]["spans"]} == {"apache", "bsd"}
    assert len(rows[1]["spans"]) == 400
    spans = sorted((s["start"], s["stop"]) for s in rows[1]["spans"])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_scan_of_an_empty_table(spark):
    docs = documents(spark, ["mit license"]).limit(0)
    assert license_automaton.scan(docs).count() == 0
    with pytest.raises(ValueError):
        license_automaton.Scanner([("x", "a b c " * license_automaton.MAX_WORDS)], [])


def test_scan_with_other_templates(spark):
    docs = documents(spark, ["our own house rules hold here", "none"])
    rows = license_automaton.scan(docs, [("house", "our own house rules hold")], []).orderBy(
        "doc_id").collect()
    assert [[s["label"] for s in r["spans"]] for r in rows] == [["house"], []]
    assert rows[0]["places"] == []
    assert rows[0]["n_words"] == 6
