"""Operators on documents and pages, held against plain Python over small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadcast.llm import (chunk_sentencepiece, hilbert_shards, host_boilerplate, kn_toxicity,
                          line_templates, pii_votes, simhash_balls, sumsq_packing)
from loadcast.llm.common import connected_components, with_running_total

tokenizers = pytest.importorskip("public_tokenizers")
PIECES = tokenizers.path("piece_bpe_32k.model")
WORDS = tokenizers.path("word_bpe_49k.json")
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, key string, "
           "line string, at string, fp string, score string, tokens string, `a b` string")


def documents(spark, texts, ids=None):
    """A documents table with nulls and with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 5}",
             None if t is None else len(t), *["x"] * 7) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, COLUMNS)


def sample_texts(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    out = [None, "", " ", "\n\n", "one", "x" * 5000, "word " * 30_000]
    for k in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(4)]
        if k % 3 == 0:
            lines.insert(1, shared[k % 2])
        if k % 5 == 0:
            lines.append(f"visit {rng.randint(0, 99)} of {rng.randint(0, 9999)} by user{k}@x.org")
        out.append("\n".join(lines))
    return out + out[8:12]


# ------------------------------------------------------------------------------ helpers
def test_running_total(spark):
    df = spark.createDataFrame([(i % 7, i, i % 3) for i in range(200)], "g int, i int, w int")
    rows = with_running_total(df, ["g", "i"]).collect()
    assert [r["i"] for r in sorted(rows, key=lambda r: r["before"])] == \
        [r["i"] for r in sorted(rows, key=lambda r: (r["g"], r["i"]))]
    total = 0
    for r in sorted(with_running_total(df, ["g", "i"], "w").collect(),
                    key=lambda r: (r["g"], r["i"])):
        assert r["before"] == total
        total += r["w"]
    assert with_running_total(df.limit(0), ["g"]).count() == 0


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)]
    pairs += [(200, 200 + i) for i in range(1, 60)] + [(300 + i, 301 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------------ 1
def drop_lines_by_hand(texts, ids):
    """Whole tokens, one line after the other: in each group of lines with the same number of
    tokens and the same first three, the most frequent line left takes all lines that have four
    of five tokens in common with it. Ties between equally frequent lines are left to the caller
    (the test's texts have none that matter)."""
    lines, docs = [], dict.fromkeys(zip(ids, texts))
    for i, t in docs:
        for at, raw in enumerate(t.split("\n") if t is not None else []):
            fixed = tuple("<*>" if re.search("[0-9@]", w) else w for w in raw.split())
            tokens = tuple(raw.split()) if set(fixed) == {"<*>"} else fixed
            if len(tokens) > 2 or re.search(r"[^\W_]", " ".join(tokens)):
                lines.append(((i, t), at, tokens))
    count, where, leaves = defaultdict(int), defaultdict(set), defaultdict(list)
    for doc, _, tokens in lines:
        count[tokens] += 1
        where[tokens].add(doc)
    for tokens in count:
        leaves[(len(tokens), tokens[:3])].append(tokens)
    template = {}
    for members in leaves.values():
        left = sorted(members, key=lambda m: -count[m])
        while left:
            top = left[0]
            taken = [m for m in left if 5 * sum(map(str.__eq__, m, top)) >= 4 * len(m)]
            template.update(dict.fromkeys(taken, top))
            left = [m for m in left if m not in taken]
    docs_of = defaultdict(set)
    for m, t in template.items():
        docs_of[t] |= where[m]
    first = {t: min(d, key=lambda d: (d[0] is not None, d[0] or 0)) for t, d in docs_of.items()}
    gone = defaultdict(set)
    for doc, at, tokens in lines:
        t = template[tokens]
        if len(docs_of[t]) > 1 and doc != first[t]:
            gone[doc].add(at)
    return {d: (None if d[1] is None else
                "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]))
            for d in docs}


def test_line_templates(spark):
    texts = sample_texts()
    ids = [k + (k > 60) * 1000 for k in range(len(texts))]
    docs = documents(spark, texts + texts[-2:], ids + ids[-2:])
    got = line_templates.drop_recurring_lines(docs).collect()
    want = drop_lines_by_hand(texts, ids)
    assert len(got) == len(texts) + 2
    assert set(docs.columns) <= set(got[0].asDict())
    for r in got:
        original = texts[ids.index(r["doc_id"])]
        assert r["text"] == want[(r["doc_id"], original)]
        assert r["_llm_lines"] == (0 if original is None else len(original.split("\n")))
    assert sum(r["_llm_dropped"] for r in got) > 20


def test_line_templates_similar_lines(spark):
    base = [f"w{chr(97 + k % 26)}{'abc'[k % 3]}{'xyz'[k // 26]}" for k in range(60)]
    near = base[:30] + ["other"] + base[31:]
    far = base[:3] + ["q"] * 57
    docs = documents(spark, ["\n".join(" ".join(x) for x in ls) for ls in
                             ([base], [near], [far], [base])])
    got = {r["doc_id"]: r["_llm_dropped"] for r in
           line_templates.drop_recurring_lines(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}


def dropped_lines(spark, texts):
    return [r["_llm_dropped"] for r in line_templates.drop_recurring_lines(
        documents(spark, texts)).orderBy("doc_id").collect()]


def test_every_template_of_a_leaf_recurs(spark):
    """Several families of lines behind the same opener, none a majority, each line once."""
    rng = random.Random(8)
    tails = [[f"{'abcdefgh'[f]}{'klmnopqrst'[k]}" for k in range(10)] for f in range(6)]
    texts = []
    for f, tail in enumerate(tails):
        for k in range(12):
            own = list(tail)
            own[rng.randrange(10)] = "v" + "xyzuvwabcdef"[k]
            texts.append("INFO the job " + " ".join(own if k else tail))
            if not k:
                texts += [texts[-1]] * (f + 1)      # the family's most frequent line
    want = drop_lines_by_hand(texts, range(len(texts)))
    assert dropped_lines(spark, texts) == [int(want[(i, t)] != t) for i, t in enumerate(texts)]
    assert sum(dropped_lines(spark, texts)) == len(texts) - 6


def test_whole_tokens_decide(spark):
    line = [f"{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefg'[k // 26]}" for k in range(160)]
    near, far = list(line), list(line)
    for k in (9, 49, 89, 129):                  # 97.5 % equal, one word changed in four stretches
        near[k] = "changed"
    for k in range(10, 10 + 33):                # 33 of 160: less than four of five are equal
        far[k] = "changed"
    texts = [" ".join(x) for x in (line, line, near, far)]
    assert dropped_lines(spark, texts) == [0, 1, 1, 0]


def test_short_lines(spark):
    texts = ["Advertisement\nbody of a", "Advertisement\nanother body here", "Read more\n---\n}",
             "Read more\n---\n}", "Page 12\n7 8 9\n17", "Page 13\n8 9 7\n18", "7 8 9\n17"]
    assert dropped_lines(spark, texts) == [0, 1, 0, 1, 0, 1, 2]


def test_text_of_very_many_lines(spark):
    text = "\n".join(f"line {k % 7} of {'abcdefg'[k % 7] * (k % 50 + 1)}" for k in range(200_000))
    assert dropped_lines(spark, [text, text, None]) == [0, 200_000, 0]


def test_position_mask(spark):
    rows = spark.createDataFrame([([0, 1, 4],), ([2],), ([5, 0],)], "at array<int>")
    got = [r[0] for r in rows.select(line_templates.position_mask(F.col("at"))).collect()]
    assert got == [[k in at for k in range(max(at) + 1)] for at in ([0, 1, 4], [2], [5, 0])]


def test_line_templates_empty(spark):
    assert line_templates.drop_recurring_lines(documents(spark, []).limit(0)).count() == 0


# ------------------------------------------------------------------------------ 6
def by_hand_fingerprint(text):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(prints, r):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= r:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_ball_hashing_finds_every_link(spark, r):
    rng = random.Random(r)
    prints = [rng.getrandbits(64) for _ in range(12)]
    for p in list(prints):
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.append(q)
    prints = list(dict.fromkeys([0, 7, (1 << 64) - 1, *prints]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash_balls.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), r)
    rows = links.collect()
    assert all(0 < ((a ^ b) & (2 ** 64 - 1)).bit_count() <= r for a, b in rows)
    got = {x["node"]: x["component"] for x in connected_components(links).collect()}
    want = groups_by_hand(prints, r)
    mine = [got.get(s, s) for s in signed]
    pairs = {(a, b) for a, b in zip(mine, want)}
    assert len(pairs) == len(set(mine)) == len(set(want))


def test_simhash_groups(spark):
    texts = sample_texts(30)
    long = "alpha beta gamma delta " * 80
    texts += [long, long + "omega", "Ünïcode TEXT here", "ünïcode text here"]
    docs = documents(spark, texts + [None], [*range(len(texts)), None])
    got = simhash_balls.near_duplicate_groups(docs).collect()
    prints = [by_hand_fingerprint(t) for t in texts]
    want = groups_by_hand(prints, 3)
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got if r["doc_id"] is not None} == \
        dict(enumerate(prints))
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == \
        dict(enumerate(want))
    kept = simhash_balls.keep_one_of_each_group(docs.unionByName(docs.limit(5)))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash_balls.near_duplicate_groups(docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------ 4
@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_connected(dims, bits):
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
    index = hilbert_shards.hilbert_index(grid, bits)
    assert sorted(index) == list(range(side ** dims))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_shards(spark, tmpdir_path):
    texts = sample_texts()
    docs = documents(spark, texts + [texts[9]] * 20, [*range(len(texts)), *[5] * 20])
    rows = hilbert_shards.shard_documents(docs, 16).collect()
    assert len(rows) == len(texts) + 20
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    sizes = [len(by_shard[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by_shard.values())
    order = [r["hilbert"] for s in range(16) for r in sorted(by_shard[s], key=lambda r: r["slot"])]
    assert order == sorted(order)
    for r in rows:
        if r["doc_id"] != 5:
            t = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    assert hilbert_shards.shard_documents(docs.limit(0), 16).count() == 0
    manifest = hilbert_shards.write_shards(docs, tmpdir_path + "/shards", 16).collect()
    back = spark.read.parquet(tmpdir_path + "/shards")
    assert back.count() == len(rows) == sum(m["rows"] for m in manifest)
    assert all(m["min_size"] <= m["max_size"] for m in manifest)


def test_level_cuts_are_balanced(spark):
    df = spark.createDataFrame([(float(i), "hot" if i % 3 else f"v{i:04d}") for i in range(900)],
                               "x double, s string")
    cuts = hilbert_shards.level_cuts(df, ["x", "s"], 8)
    assert len(cuts["x"]) == 7
    sizes = [r["count"] for r in df.groupBy(
        hilbert_shards.level_of(F.col("x"), cuts["x"])).count().collect()]
    assert max(sizes) - min(sizes) <= 2
    assert cuts["s"] == sorted(cuts["s"]) and len(cuts["s"]) <= 7


# ------------------------------------------------------------------------------ 5
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁\t\nabcé中😀　ﬁ́<s>0\u0000")), max_size=30))
def test_sentencepiece_equals_the_library(text):
    table = chunk_sentencepiece.word_table(PIECES)
    ids, plain = table.encode([text])[0]
    want = table.model.encode(text)
    assert ids == ",".join(map(str, want))
    assert plain == table.model.decode(want)


def test_sentencepiece_table_overflow(monkeypatch):
    monkeypatch.setattr(chunk_sentencepiece, "TABLE_WORDS", 50)
    table = chunk_sentencepiece.WordTable(PIECES)
    texts = [t or "" for t in sample_texts(40)]
    for group in chunk_sentencepiece.in_groups(texts, 500):
        for text, (ids, plain) in zip(group, table.encode(group)):
            assert ids == ",".join(map(str, table.model.encode(text)))
            assert plain == text


def test_sentencepiece_documents(spark):
    texts = sample_texts(20)
    docs = documents(spark, texts)
    model = chunk_sentencepiece.word_table(PIECES).model
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chunk_sentencepiece.encode_digests(docs, PIECES).collect():
        ids = model.encode(texts[r["doc_id"]] or "")
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
    encoded = chunk_sentencepiece.encode_documents(docs, PIECES)
    back = encoded.select("doc_id", "decoded",
                          chunk_sentencepiece.decode_ids(F.col("ids"), PIECES).alias("again"))
    assert all(r["decoded"] == r["again"] == (texts[r["doc_id"]] or "") for r in back.collect())
    assert chunk_sentencepiece.encode_digests(docs.limit(0), PIECES).count() == 0


# ------------------------------------------------------------------------------ 8
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \t\nabSÉéİΣ中😀　́'sm1²_-!\x85\x1c ")),
               max_size=30))
def test_packing_ids_equal_the_library(text):
    table = sumsq_packing.word_ids(WORDS)
    for t in (text, text + "<|endoftext|>" + text):
        assert table.encode(t) == table.whole(t)


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(2)
    packer = sumsq_packing.LevelPacker(16)
    for _ in range(400):
        n = rng.randint(1, 15)
        counts = packer.counts.copy()
        best = None
        for level in [h for h in range(1, 17 - n) if counts[h]] + [0]:
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + n < 16:
                after[level + n] += 1
            cost = int((after[1:] ** 2).sum())
            best = min(best or (cost, -level), (cost, -level))
        assert packer.level_for(n) == -best[1]
        packer.place("d", 0, np.zeros(n, np.uint32))


def test_packing(spark):
    texts = sample_texts()
    docs = documents(spark, texts + texts[:3], [*range(len(texts)), 900, 901, 902])
    rows = sumsq_packing.pack_documents(docs, WORDS, with_ids=True).collect()
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORDS)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert len(pieces) == len(texts) + 3
    for doc, ps in pieces.items():
        text = texts[doc % 900 if doc >= 900 else doc] or ""
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        ps.sort(key=lambda r: r["start"])
        assert [i for r in ps for i in r["ids"]] == ids
        assert [r["start"] for r in ps] == list(np.cumsum([0] + [r["length"] for r in ps])[:-1])
        assert {r["doc_tokens"] for r in ps} == {len(ids)}
    for ps in sequences.values():
        ps.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in ps)
        assert n <= 2048 and n & (n - 1) == 0
        assert [r["offset"] for r in ps] == list(np.cumsum([0] + [r["length"] for r in ps])[:-1])
    assert sumsq_packing.pack_documents(docs.limit(0), WORDS).count() == 0


# ------------------------------------------------------------------------------ 3
def base_by_hand(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {"email": [m.span() for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x)
                 if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x)
                   if 16 <= len(digits(m[0])) <= 19 and sum(
                       sum(divmod(int(c) * (1 + i % 2), 10))
                       for i, c in enumerate(reversed(digits(m[0])))) % 10 == 0]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x)
                    if 8 <= len(digits(m[0])) <= 15]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "b.c", "@", "x@y.z", ".", "-", " ", "1", "25", "300", "007", "1.2.3.4", "+1", "+", "(",
     ")", "4111111111111111", "4111 1111 1111 1111", "é", "٣", "%", "\n"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii_votes.base_spans(text) == base_by_hand(text)


def test_personal_data(spark):
    phone = "call me at (020) 555-1234 or 030-555-9876 today"
    texts = sample_texts(20) + [
        "mail jane.doe@mail.example.com, phone +44 (20) 555-1234 x", phone,
        "write to jane [at] mail [dot] com or bob at mail dot org now",
        "phone +1 (826) 555-4081 190.137.223.204 and 4111 1111 1111 1111",
        "version 1.2.3.4 300.1.1.1 order 4111111111111112"] * 4
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in pii_votes.annotate(docs).collect()}
    for i, t in enumerate(texts):
        base = base_by_hand(t or "")
        joined = pii_votes.joined(base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii_votes.KINDS] == [len(base[k]) for k in
                                                               pii_votes.KINDS]
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
    added = [s for i, t in enumerate(texts) if t == phone for s in got[i]["spans"].split(",")]
    assert any(s.startswith("phone:") for s in added)
    clean = pii_votes.redact(docs)
    assert clean.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert rows[0] is None and rows[1] == ""
    assert all("@mail.example.com" not in (t or "") for t in rows.values())
    assert pii_votes.annotate(docs.limit(0)).count() == 0


def test_expectation_maximisation_orders_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    v = np.zeros((4000, 6), int)
    for j, right in ((1, 0.95), (2, 0.9), (3, 0.6), (4, 0.55), (5, 0.85)):
        ok = rng.random(4000) < right
        v[:, j] = np.where(truth == ok, 1, -1)
    kind = rng.integers(0, 4, 4000)
    post, table = pii_votes.estimate(kind, v, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95
    reliability = table[1][1:, 2] - table[0][1:, 2]
    assert reliability[0] > reliability[1] > reliability[2]


# ------------------------------------------------------------------------------ 7
PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"
        "<nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class='ad'>Buy now</div>{0}"
        "<footer>&copy; host &middot; all rights</footer></body></html>")


def test_page_blocks():
    page = PAGE.replace("{0}", "<article><h1>T &amp; U</h1><p>a <b>b</b>\n c<p>d<script>if(a<b)"
                               "</script> e<aside>no</aside></p><div class=\"comments\">x</div>"
                               "<form>f</form>&lt;z 1 < 2</article>")
    main = [t for z, t in host_boilerplate.blocks_of(page) if z == host_boilerplate.MAIN]
    assert main == ["T & U", "a b c", "d e", "<z 1 < 2"]
    assert host_boilerplate.blocks_of("") == []
    for broken in ("<", "<a", "<a href='", "<!--", "<script>x", "</p>", "&am", "<p>" * 3000):
        host_boilerplate.blocks_of(broken)


def test_extraction(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    boiler = " ".join(word() for _ in range(12))
    rows, want = [], []
    for i in range(30):
        own = [" ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(3)]
        host = f"h{i % 3}.org"
        if i % 2:
            body, text = "<article>" + "".join(f"<p>{o}</p>" for o in own) + "</article>", own
        else:
            body = f"<div>{boiler}</div>" + "".join(f"<div>{o}</div>" for o in own)
            text = own
        rows.append((i, f"https://{host}/p/{i}", PAGE.replace("{0}", body), "x"))
        want.append("\n".join(text))
    rows += [(90, None, None, "x"), (91, "not a url", "", "x"), (92, "https://h0.org/q", "<nav>n", "x")]
    schema = "page_id long, url string, html string, blocks string"
    pages = spark.createDataFrame(rows + rows[:1], schema)
    got = host_boilerplate.extract(pages).collect()
    assert len(got) == len(rows) + 1
    text = {r["page_id"]: r["text"] for r in got}
    assert [text[i] for i in range(30)] == want
    assert text[90] == text[91] == text[92] == ""
    assert host_boilerplate.extract(pages.limit(0)).count() == 0


def test_suffixes_cover_what_brute_force_covers(spark):
    rng = random.Random(5)
    run = 4
    pages = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(6)]
    rows = [(i, "http://h/", "<div>" + " ".join(p) + "</div>") for i, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in host_boilerplate.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string"), run).collect()}
    for i, p in enumerate(pages):
        others = {tuple(q[k:k + run]) for j, q in enumerate(pages) if j != i
                  for k in range(len(q) - run + 1)}
        gone = {k + d for k in range(len(p) - run + 1) if tuple(p[k:k + run]) in others
                for d in range(run)}
        assert got[i] == " ".join(w for k, w in enumerate(p) if k not in gone)


def test_suffixes_decide_open_blocks_of_marked_pages(spark):
    """A headline before the article and text after it stay; what other pages of the host repeat
    goes, unless an article holds it."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5))
                               for _ in range(n))
    boiler, shared = words(12), words(10)
    rows, want = [], []
    for i in range(4):
        title, article, rest = words(9), [words(20), shared, boiler], words(15)
        body = (f"<h1>{title}</h1><div>{boiler}</div><article>"
                + "".join(f"<p>{p}</p>" for p in article) + f"</article><div>{rest}</div>")
        rows.append((i, f"https://h.org/{i}", PAGE.replace("{0}", body)))
        want.append("\n".join([title, *article, rest]))
    rows.append((4, "https://h.org/4", PAGE.replace("{0}", f"<div>{boiler}</div><main>m</main>")))
    got = {r["page_id"]: r["text"] for r in host_boilerplate.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [*want, "m"]


def _texts(spark, bodies, host="h.org"):
    rows = [(i, f"https://{host}/{i}", PAGE.replace("{0}", b).replace("Home", f"Home {i}"))
            for i, b in enumerate(bodies)]
    got = host_boilerplate.extract(spark.createDataFrame(
        rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_copies_of_an_unmarked_page_keep_their_text(spark):
    """Copies under other addresses count as one page; what a page of other content repeats goes
    from all of them, and from marked pages that agree in nothing but it."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5))
                               for _ in range(n))
    article, boiler = words(60), words(12)
    copies = [f"<div>{article}</div>"] * 5
    assert _texts(spark, copies) == [article] * 5
    with_boiler = [f"<div>{boiler}</div><div>{article}</div>"] * 5
    assert _texts(spark, with_boiler + [f"<div>{boiler}</div><div>x y</div>"]) == [
        *[article] * 5, "x y"]
    own = [words(20) for _ in range(3)]
    assert _texts(spark, [f"<article>{o}</article><div>{boiler}</div>" for o in own]) == own


def test_what_articles_of_the_host_repeat_is_text(spark):
    """A passage that stands in as many articles as elsewhere stays in open blocks."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5))
                               for _ in range(n))
    passage = words(15)
    openly = [f"<div>{words(10)}</div><div>{passage}</div>" for _ in range(2)]
    marked = [f"<article><p>{words(10)}</p><p>{passage}</p></article>" for _ in range(2)]
    for held in (0, 1, 2):
        got = _texts(spark, openly + marked[:held])
        assert [passage in t for t in got] == [held == 2] * 2 + [True] * held


# ------------------------------------------------------------------------------ 9
def ratios_by_hand(texts, labels):
    """Word ratios by the formulas, with plain dictionaries."""
    def starts(word):
        return [word[:k] for k in range(1, len(word) + 1)]

    n = [defaultdict(int) for _ in range(3)]
    for text, label in zip(texts, labels):
        for w in set(kn_toxicity.words_of(text)):
            for s in starts(w):
                n[0][s] += 1
                if label is not None:
                    n[1 if label else 2][s] += 1
    total, kinds = [defaultdict(int) for _ in range(3)], [defaultdict(int) for _ in range(3)]
    for c in range(3):
        for s, v in n[c].items():
            total[c][s[:-1]] += v
            kinds[c][s[:-1]] += v > 0
    follows = defaultdict(int)
    for s in n[0]:
        follows[s[-1]] += 1

    def p(c, s):
        ctx = s[:-1]
        if c == 0:
            d, lower = kn_toxicity.SHARED_DISCOUNT, follows[s[-1]] / len(n[0])
        else:
            d, lower = kn_toxicity.CLASS_DISCOUNT, p(0, s)
        if not total[c][ctx]:
            return lower
        return (max(n[c][s] - d, 0) + d * kinds[c][ctx] * lower) / total[c][ctx]

    return lambda word: sum(np.log(p(1, s) / p(2, s)) for s in starts(word))


def test_step_ratios(spark):
    texts = [t for t in sample_texts(40) if t]
    labels = [None if k % 4 == 0 else int(k % 4 == 1) for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, labels)), "text string, toxic int")
    seen, unseen = kn_toxicity.step_ratios(kn_toxicity.word_counts(df))
    pull = lambda d: (lambda p: (p["key"].to_numpy(), p["ratio"].to_numpy()))(d.toPandas())  # noqa
    model = kn_toxicity.Model(pull(seen), pull(unseen))
    by_hand = ratios_by_hand(texts, labels)
    words = sorted({w for t in texts for w in kn_toxicity.words_of(t)})[:400]
    model.learn(words)
    for w in words:
        assert model.words[w] == pytest.approx(by_hand(w), abs=1e-3)


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = "zzyx" + word()
            words[rng.randrange(len(words))] = "zzyx" + word()
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    texts += ["", None]
    docs = documents(spark, texts, [*range(601), None])
    marked = spark.createDataFrame(labels + [(None, 1), (3, None), (7, 0)],
                                   "doc_id long, toxic int")
    scored = kn_toxicity.score_documents(docs, marked)
    assert scored.columns == [*docs.columns, "score"] or "score" in docs.columns
    scored = kn_toxicity.score_documents(docs, marked, name="_s").collect()
    held = [r for r in scored if r["doc_id"] is not None and r["doc_id"] < 600
            and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["_s"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held]
    assert len(scored) == 602 and np.mean(right) > 0.9
    assert all(0 <= r["_s"] <= 1 for r in scored)
    none = kn_toxicity.score_documents(docs, marked.limit(0), keep=("doc_id",)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert kn_toxicity.score_documents(docs.limit(0), marked, name="_s").count() == 0


@pytest.mark.parametrize("spaced", [True, False])
def test_toxicity_reads_whole_words(spark, spaced):
    """Words that differ after their eighth letter only, and text without spaces."""
    rng = random.Random(8)
    texts = []
    for i in range(600):
        if spaced:
            words = ["compound" + "".join(rng.choices("abcdef", k=4)) for _ in range(20)]
            if i % 4 == 0:
                words[rng.randrange(20)] = "compoundzzyx"
            texts.append(" ".join(words))
        else:
            run = [chr(0x4e00 + rng.randrange(20)) for _ in range(60)]
            if i % 4 == 0:
                run[(at := rng.randrange(10, 50)):at + 4] = "\u4e07\u4e03\u4e11\u4e05"
            texts.append("".join(run))
    for t in texts[:8]:
        letters = [p[5:] if p[0] == kn_toxicity.LATER else p.lstrip(kn_toxicity.FIRST)
                   for p in kn_toxicity.pieces_of(t)]
        assert "".join(letters) == t.replace(" ", "")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)],
                                   "doc_id long, toxic int")
    scored = kn_toxicity.score_documents(documents(spark, texts), labels, name="_s").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    toxic, other = ([r["_s"] for r in held if (r["doc_id"] % 4 == 0) == kind]
                    for kind in (True, False))
    assert len(toxic) > 15 and len(other) > 50
    assert np.mean([t > o for t in toxic for o in other]) > 0.9


def test_packing_tables_go_with_their_broadcast():
    """What is sent to the workers carries no table, and no module keeps one."""
    import pickle
    table = sumsq_packing.word_ids(WORDS)
    ids = table.encode("the first words")
    sent = pickle.loads(pickle.dumps(table))
    assert "first" in table.words and "first" in table.parts
    assert "first" not in sent.words and "first" not in sent.parts
    assert sent.encode("the first words") == ids == table.whole("the first words")
    assert sumsq_packing.word_ids(WORDS) is not table


def test_word_counts_of_a_task_are_bounded_within_a_batch(monkeypatch):
    """One batch of many words is counted in several parts with the same sums."""
    import pyarrow as pa
    monkeypatch.setattr(kn_toxicity, "WORDS_KEPT", 50)

    class Docs:
        def mapInArrow(self, run, schema):
            raise StopIteration(run)

    try:
        kn_toxicity.word_counts(Docs())
    except StopIteration as caught:
        run = caught.value
    texts = [f"common w{i} v{i}" for i in range(100)] + [None]
    marks = [1 if i % 3 == 0 else 0 if i % 3 == 1 else None for i in range(101)]
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(marks)],
                                                    ["text", "toxic"])])))
    assert max(b.num_rows for b in out) < 50 + 3 and len(out) > 1
    rows = [r for b in out for r in b.to_pylist()]
    sums = [sum(r[c] for r in rows if r["word"] == "common")
            for c in ("n_all", "n_toxic", "n_ordinary")]
    assert sums == [100, 34, 33]


def test_a_kept_text_is_sent_to_the_scorer_once(spark):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} word{i % 7} text") for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    out = kn_toxicity.score_documents(docs, labels)
    assert "_llm_text" not in out._jdf.queryExecution().analyzed().toString()
    slim = kn_toxicity.score_documents(docs, labels, keep=("doc_id",))
    assert out.columns == ["doc_id", "text", "score"] and slim.columns == ["doc_id", "score"]
    assert ({(r["doc_id"], r["text"]) for r in out.collect()} == {*rows, (None, None)}
            and sorted(r["score"] for r in out.collect())
            == sorted(r["score"] for r in slim.collect()))
