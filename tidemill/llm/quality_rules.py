"""Quality rules with adaptive thresholds (built-in functions only).

Every text is measured inside its row, so no word is shuffled. The measures of all texts that pass the base rule are
summarised by mergeable quantile sketches per language and source, per language, and over everything; each (language, source)
takes its limits from its own sketch, or from the next wider one where it has too few texts. A join with the table of limits
gives the verdicts.

A limit is read off the group's own ladder of quantiles, from the median up: where the next step is wider than GAP times the
spread below it (the distance down to the median, at least that of the upper quartile, at least one occurrence, or one word's
characters, in a text of the group's median length), the upper texts lie apart from the rest, and the limit is the middle of that first gap. A ladder without
such a gap has no limit: its texts are all of a piece. So no cutoff is fixed, junk is found as far as it stands apart in its own
group (as long as it is the lesser part), and a group whose clean texts are unusual for the corpus keeps them.

Defined results: null text has no words (all measures 0, base rule fails); texts are measured whole; ties at a limit pass; empty
tables give empty results; null language or source is a group of its own; repeated rows are judged each; extra columns are carried
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, discard, fresh, maybe_broadcast, stash

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A group needs this many texts to set its own limits.
MIN_GROUP = 40
#: Rank accuracy of a sketch: one in this many.
ACCURACY = 10_000
#: A step of the ladder is a gap from so many times the spread below it.
GAP = 8.0
#: Ranks of the ladder: the upper half in 32nds, then closer.
LADDER = [*[k / 32 for k in range(16, 32)], 63 / 64, 127 / 128, 255 / 256, 1.0]
#: The upper quartile's place in the ladder, from 0.
_QUARTILE = LADDER.index(0.75)
#: Rows of the table of limits that may be broadcast.
BROADCAST_ROWS = 100_000
#: measure -> what its occurrences are counted in.
UPPER = {"symbol_ratio": "n_words", "dup_line_ratio": "n_lines", "repeat_ratio": "n_words", "mean_chars": "n_words"}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _at(items: Column, i: Column) -> Column:
    return F.get(items, i)


def counted(docs: DataFrame, into: str) -> DataFrame:
    """docs plus a struct column of the counts of COUNTS and n_lines (lines with a word)."""
    text, words, sizes, hashes, grams, hits, lines = fresh(docs, "_text", "_words", "_sizes", "_hashes", "_grams", "_hits", "_lines")
    df = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != ""))
    df = df.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    dup_lines = F.size(lines) - F.size(F.array_distinct(lines))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    df = df.withColumn(sizes, F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines")))
    df = df.drop(text, lines)
    window = F.transform(words, lambda w, i: F.xxhash64(w, _at(F.col(words), i + 1), _at(F.col(words), i + 2)))
    df = df.withColumn(hashes, F.slice(window, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))).drop(words)
    # Windows of three words as (hash, position), sorted, so that equal windows are neighbours; most texts repeat none.
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(grams, F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), none).otherwise(F.sort_array(pairs))).drop(hashes)
    same = lambda x, k: F.coalesce(_at(F.col(grams), k)["h"] == x["h"], F.lit(False))
    df = df.withColumn(hits, F.array_sort(F.transform(F.filter(grams, lambda x, k: same(x, k + 1) | (k > 0) & same(x, F.greatest(k - 1, F.lit(0)))), lambda x: x["i"]))).drop(grams)
    spans = F.transform(hits, lambda p, k: F.least(F.lit(3), F.coalesce(_at(F.col(hits), k + 1) - p, F.lit(3))))
    repeat = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    # The generator keeps filters above from being pushed into, and so multiplying, the expressions below.
    counts = F.struct(*[F.col(sizes)[c].alias(c) for c in (*COUNTS[:4], "n_lines")], repeat.alias("n_repeat_words"))
    return df.withColumn(into, F.explode(F.array(counts))).drop(sizes, hits)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def _ratios(c: Column) -> dict[str, Column]:
    words = F.greatest(c["n_words"], F.lit(1))
    return {
        "symbol_ratio": c["n_symbols"] / words,
        "dup_line_ratio": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "repeat_ratio": c["n_repeat_words"] / words,
        "mean_chars": c["word_chars"] / words,
    }


def _limit(steps: Column, unit: Column) -> Column:
    """The middle of a ladder's first gap; infinite without one."""

    def middle(low: Column, k: Column) -> Column:
        high, least = _at(steps, k + 1), F.greatest(steps[_QUARTILE] - steps[0], unit)
        return F.when(high - low > GAP * F.greatest(low - steps[0], least), (low + high) / 2)

    return F.coalesce(_at(F.filter(F.transform(steps, middle), lambda x: x.isNotNull()), F.lit(0)), F.lit(float("inf")))


def limits(measured: DataFrame, counts: str) -> DataFrame:
    """(lang, source, one limit per measure), one row per group of texts that pass the base rule.

    Quantile summaries merge, so every task sends one summary per group whatever the group holds."""
    c = F.col(counts)
    passing = measured.where(~base_failed(c)).select("lang", "source", *[v.alias(k) for k, v in _ratios(c).items()], *[F.greatest(c[x], F.lit(1)).alias(x) for x in ("n_words", "n_lines")])
    sketched = [F.percentile_approx(m, F.array(*map(F.lit, LADDER)), ACCURACY).alias(m) for m in UPPER]
    middle = [F.percentile_approx(x, 0.5, ACCURACY).alias(x) for x in ("n_words", "n_lines")]
    sets = passing.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *sketched, *middle)
    sets, path = stash(sets, "ladders")
    sets = sets.select("lang", "source", "level", "n", *[_limit(F.col(m), (F.col(m)[0] if m == "mean_chars" else F.lit(1.0)) / F.col(x)).alias(m) for m, x in UPPER.items()])
    part = lambda level, s: sets.where(F.col("level") == level).select(*(["lang", "source"], ["lang"], [])[level if level < 2 else 2], F.struct("n", *UPPER).alias(s))
    own, lang, world = part(0, "own"), part(1, "wide").withColumnRenamed("lang", "l2"), part(3, "world")
    lang = maybe_broadcast(lang, BROADCAST_ROWS)
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l2"]), "left").join(F.broadcast(world), F.lit(True), "left")
    pick = F.when(F.col("own.n") >= MIN_GROUP, F.col("own")).when(F.col("wide.n") >= MIN_GROUP, F.col("wide")).otherwise(F.col("world"))
    out, _ = stash(joined.withColumn("pick", pick).select("lang", "source", *[F.col("pick")[m].alias(m) for m in UPPER]), "limits")
    discard(measured.sparkSession, path)
    return out


def judge(measured: DataFrame, counts: str, kept: str, thresholds: DataFrame | None = None) -> DataFrame:
    """measured plus the boolean column kept: passes the base rule and lies within its group's limits.

    A group without limits has no text that passes the base rule, so nothing is lost by the outer join."""
    lang, source, lim = fresh(measured, "_lim_lang", "_lim_source", "_lim")
    t = (limits(measured, counts) if thresholds is None else thresholds).select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*UPPER).alias(lim))
    t = maybe_broadcast(t, BROADCAST_ROWS)
    out = measured.join(t, measured["lang"].eqNullSafe(t[lang]) & measured["source"].eqNullSafe(t[source]), "left")
    within = F.lit(True)
    for m, ratio in _ratios(F.col(counts)).items():
        within = within & (ratio <= F.col(lim)[m])
    return out.withColumn(kept, ~base_failed(F.col(counts)) & F.coalesce(within, F.lit(False))).drop(lang, source, lim)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules accept, with their own columns. Texts are measured once and written with their counts: the
    limits read the counts alone, and the verdicts need no shuffle of texts."""
    counts, kept = fresh(docs, "_counts", "_kept")
    measured, _ = stash(counted(docs, counts), "measured")
    return judge(measured, counts, kept).where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and verdict; only the narrow counts are kept between the two passes."""
    counts, _kept = fresh(docs, "_counts", "_kept")
    narrow, _ = stash(counted(docs.select("doc_id", "lang", "source", "text"), counts).select("doc_id", "lang", "source", counts), "measures")
    c = F.col(counts)
    return judge(narrow, counts, "kept").select("doc_id", *[c[x].alias(x) for x in COUNTS], base_failed(c).alias("base_failed"), "kept")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i+1], ws[i+2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM k WHERE n >= 2) GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  n_symbols / greatest(n_words, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
  n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_chars FROM c),
s AS (SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, {', '.join(f"quantile_disc({m}, {LADDER}) AS {m}, {'quantile_disc(mean_chars, 0.5)' if m == 'mean_chars' else '1.0'} / quantile_disc(greatest({x}, 1), 0.5) AS {m}_unit" for m, x in UPPER.items())}
  FROM b WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())),
y AS (SELECT lang, source, level, n, {', '.join(f"coalesce(list_transform(list_filter(range(1, {len(LADDER)}), lambda k: {m}[k + 1] - {m}[k] > {GAP} * greatest({m}[k] - {m}[1], {m}[{_QUARTILE + 1}] - {m}[1], {m}_unit)), lambda k: ({m}[k] + {m}[k + 1]) / 2)[1], CAST('inf' AS DOUBLE)) AS {m}" for m in UPPER)} FROM s),
p AS (SELECT o.lang, o.source, {', '.join(f"CASE WHEN o.n >= {MIN_GROUP} THEN o.{m} WHEN x.n >= {MIN_GROUP} THEN x.{m} ELSE z.{m} END AS {m}" for m in UPPER)}
  FROM (SELECT * FROM y WHERE level = 0) o LEFT JOIN (SELECT * FROM y WHERE level = 1) x ON o.lang IS NOT DISTINCT FROM x.lang CROSS JOIN (SELECT * FROM y WHERE level = 3) z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce({' AND '.join(f"b.{m} <= p.{m}" for m in UPPER)}, false)) AS kept
FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source
"""
