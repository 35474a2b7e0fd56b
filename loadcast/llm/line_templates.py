"""Line dedup over a log-template tree, in DataFrame operations only.

A line's tokens are its white-space-delimited words; a token that holds a digit or an ``@`` is a
variable field and reads ``<*>`` (a line of such fields only is read as it stands). The tree has a
fixed depth: a leaf is the token count and the first ``DEPTH`` tokens. Within a leaf the most
frequent line becomes a template; lines that agree with it in four of five tokens belong to it,
their differing tokens being wildcards; of the lines left the most frequent is the next template,
until none is left. Tokens are compared by 15-bit hashes, so that
no line is shuffled as text.

Two lines of a leaf that agree so far differ in one token of ``UNLIKE`` at most. With one stretch
more than these, cut from the tokens after the leading ones, they share a stretch: a line without
a stretch in common with another stands alone. Of the others a round takes each leaf's ``BLOCK``
most frequent lines (fewer, if they are very long), finds the templates among them in that order,
and compares the leaf's lines with these. A leaf with more lines than that goes on with those
that agree with none: the templates are those of one long list, whatever the block.

A template that stands in two or more distinct documents recurs. Its lines are dropped from all
of them but the first by doc_id, so one copy of every passage stays. Lines of fewer than
``MIN_TOKENS`` tokens without a letter or digit (rules, brackets) are left alone.

A line that very many documents share is summed before it is shuffled, and the joins are plain
equi-joins on checkpointed small sides, so that Spark splits their hot keys.

Defined cases: a null text has no lines and stays null; a text all of whose lines are dropped
becomes empty; rows equal in doc_id and text are one document, and each gets its result; a null
doc_id sorts first; equally frequent lines are taken by their hash; a very long text is read whole,
in time linear in its lines; an empty table gives an empty result; other columns are carried along,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spark_cores, stored

DEPTH = 3
MIN_TOKENS = 3
UNLIKE = 5                  # of so many tokens one may differ from a template
BLOCK = 256                 # lines of a leaf that a round orders, of
BLOCK_TOKENS = 1 << 21      # so many tokens, two lines at least
WILDCARD = "<*>"


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("|"), F.col(text))


def template_tokens(lines: DataFrame) -> DataFrame:
    """Column ``raw`` replaced by ``tokens``: the line's tokens with variable fields as wildcards.
    Regular expressions run only on lines that need them."""
    line = F.col("raw")
    uneven = line.startswith(" ") | line.endswith(" ")
    for mark in ("  ", "\t", "\r", "\f", "\v"):
        uneven = uneven | line.contains(mark)
    even = F.when(uneven, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)
    field = F.regexp_replace("raw", r"[^ 0-9@]*+[0-9@][^ ]*+", WILDCARD)
    fixed = F.col("field").isNull() | F.col("field").rlike(r"^<\*>( <\*>)*+$")
    return (lines.withColumn("raw", even)
            .withColumn("field", F.when(F.col("raw").rlike("[0-9@]"), field))
            .withColumn("tokens", F.split(F.when(fixed, F.col("raw")).otherwise(F.col("field")),
                                          " "))
            .drop("raw", "field"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, at, tokens, leaf, line, signature) of every line that can be a template."""
    # the text is hashed once a document, below the generator, not once a line
    split = docs.select(_key("doc_id", "text").alias("key"), "doc_id",
                        F.split("text", "\n").alias("lines"))
    lines = split.select("key", "doc_id", F.posexplode("lines").alias("at", "raw"))
    tokens, size = template_tokens(lines), F.size("tokens")
    worded = (size >= MIN_TOKENS) | F.array_join("tokens", " ").rlike(r"[\p{L}\p{N}]")
    token = lambda t: F.hash(t).bitwiseAND(0x7FFF).cast("short")        # noqa: E731
    return tokens.where(worded).select(
        "key", "doc_id", "at", size.alias("tokens"),
        F.xxhash64(size, F.slice("tokens", 1, DEPTH)).alias("leaf"),
        F.xxhash64("tokens").alias("line"),
        F.when(size >= UNLIKE, F.transform("tokens", token)).alias("signature"))


def stretches(lines: DataFrame) -> DataFrame:
    """(sub, leaf, line): the stretches of each line, one more than its tokens that may differ
    from a template's."""
    parts, size = F.floor(F.col("tokens") / UNLIKE) + 1, F.col("tokens") - DEPTH
    cut = lambda k: F.floor(size * k / F.col("parts")).cast("int")      # noqa: E731
    k = F.col("k")
    return (lines.withColumn("parts", parts).withColumn("k", F.explode(F.expr(
        "sequence(0L, parts - 1)"))).select(
            F.xxhash64("leaf", k, F.slice("signature", cut(k) + DEPTH + 1,
                                          cut(k + 1) - cut(k))).alias("sub"), "leaf", "line"))


def agree(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda equal: equal))
    return same * UNLIKE >= F.size(a) * (UNLIKE - 1)


def similar_lines(lines: DataFrame) -> DataFrame | None:
    """(leaf, line, template) of distinct lines that belong to a more frequent line's template;
    ``lines`` holds leaf, line, n, tokens and signature."""
    rows = stretches(lines).checkpoint()
    size = lines.count()
    paired = rows.join(rows.groupBy("sub").count().where("count > 1"), "sub")
    left = stored(lines.join(paired.select("leaf", "line").distinct(), ["leaf", "line"],
                             "left_semi"), size)
    by_rank = Window.partitionBy("leaf").orderBy(F.desc("n"), "line")
    joined = []
    while not left.isEmpty():
        block = (left.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= BLOCK)
                 .where((F.col("rank") <= 2) | (F.col("rank") * F.col("tokens") <= BLOCK_TOKENS)))
        ordered = block.groupBy("leaf").agg(F.sort_array(F.collect_list(
            F.struct("rank", "line", "signature"))).alias("ordered"))
        templates = stored(ordered.select("leaf", F.aggregate(
            "ordered", F.slice("ordered", 1, 0), lambda found, x: F.when(
                F.exists(found, lambda t: agree(t["signature"], x["signature"])), found
            ).otherwise(F.concat(found, F.array(x)))).alias("templates")), size)
        first = F.get(F.filter("templates", lambda t: agree(t["signature"], F.col("signature"))), 0)
        seen = stored(left.join(templates, "leaf").select(
            *left.columns, first["line"].alias("template")), size)
        joined.append(seen.where("template != line").select("leaf", "line", "template"))
        left = seen.where("template is null").drop("template")
    return reduce(DataFrame.unionByName, joined) if joined else None


def recurring_lines(lines: DataFrame) -> DataFrame:
    """(leaf, line, keep_key): lines whose template stands in several documents, and the document
    that keeps them."""
    # in no more tasks than the lines, which are at least as many
    distinct = (lines.groupBy("leaf", "line")
                .agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"),
                     F.min(F.struct("doc_id", "key", "at")).alias("first"),
                     F.min("tokens").alias("tokens"))
                .coalesce(max(lines.rdd.getNumPartitions(), spark_cores(lines.sparkSession)))
                .checkpoint())
    rows = distinct.count()
    leaves = stored(distinct.groupBy("leaf")
                    .agg(F.min("lo").alias("leaf_lo"), F.max("hi").alias("leaf_hi"),
                         F.count("*").alias("leaf_lines"))
                    .where("leaf_lo != leaf_hi").select("leaf", "leaf_lines"), rows)
    shared = stored(distinct.join(leaves, "leaf"), rows)
    places = stored(shared.where((F.col("leaf_lines") > 1) & (F.col("tokens") >= UNLIKE))
                    .select("leaf", "line", "n", "tokens", "first.key", "first.at"), rows)
    # equal documents give a place several times
    similar = similar_lines(stored(
        places.join(lines.select("key", "at", "signature"), ["key", "at"])
        .dropDuplicates(["leaf", "line"]).drop("key", "at"), rows))
    member = shared.select("leaf", "line", "lo", "hi", "first")
    if similar is None:
        member = member.withColumn("template", F.col("line"))
    else:
        member = stored(member.join(similar, ["leaf", "line"], "left")
                        .withColumn("template", F.coalesce("template", "line")), rows)
    recurring = stored(member.groupBy("leaf", "template")
                       .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                            F.min("first").alias("first")).where("lo != hi")
                       .select("leaf", "template", F.col("first.key").alias("keep_key")), rows)
    return stored(member.select("leaf", "line", "template").join(recurring, ["leaf", "template"])
                  .select("leaf", "line", "keep_key"), rows)


def position_mask(positions: Column) -> Column:
    """Array of booleans, true at the given distinct positions, up to the last of them."""
    at = F.sort_array(positions)
    before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1))
    return F.flatten(F.transform(F.zip_with(before, at, lambda p, x: x - p - 1), lambda gap: F.concat(
        F.array_repeat(F.lit(False), gap), F.array(F.lit(True)))))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines gone from ``text``, and ``_llm_lines`` and ``_llm_dropped``,
    the number of lines before and of dropped lines."""
    lines = document_lines(docs.select("doc_id", "text")).checkpoint()
    recurring = recurring_lines(lines)
    dropped = (lines.select("leaf", "line", "key", "at").join(recurring, ["leaf", "line"])
               .where("key != keep_key")
               .groupBy(F.col("key").alias("_llm_key"))
               .agg(F.collect_set("at").alias("at"))
               .select("_llm_key", position_mask(F.col("at")).alias("_llm_at"),
                       F.size("at").alias("_llm_dropped")))
    raw = F.split("text", "\n")
    kept = F.filter(raw, lambda x, i: ~F.coalesce(F.get("_llm_at", i), F.lit(False)))
    joined = docs.join(dropped, _key("doc_id", "text") == F.col("_llm_key"), "left")
    return joined.withColumns({
        "_llm_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(raw)).cast("long"),
        "_llm_dropped": F.coalesce("_llm_dropped", F.lit(0)).cast("long"),
        "text": F.when(F.col("_llm_at").isNull(), F.col("text")).otherwise(
            F.array_join(kept, "\n"))}).drop("_llm_key", "_llm_at")
