"""Quality rules with risk-controlled thresholds, in DataFrame expressions throughout.

Each rule rejects a document whose feature exceeds a cutoff from a fixed grid.  Labelled documents are
halved by a digest of doc_id.  In each stratum the first half proposes: for each rule the cutoff with the best
balance of rejected bad and good documents, and the order of the rules by that balance.  The other half, the
holdout, tests the rules joined so far, one more at a time, as one verdict: all rules up to the last proven
step are used, where P(Binomial(good, risk) <= rejected good) <= error / strata.  The steps are tested in an
order fixed before the holdout is seen, and strata by Bonferroni's correction; so with probability
1 - error the rules together reject at most ``risk`` of the good documents in every stratum.  The base rule is
given and outside of this.  A stratum with too few labels for a proof has no cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relgen.llm.tables import apart, written

RISK, ERROR, GOOD_WEIGHT = 0.05, 0.1, 20
#: Cutoffs: a document goes if its feature exceeds the cutoff, in hundredths of the named total.
RULES = {
    "symbols": ("n_symbols", "n_words", (20, 40, 60, 80, 100, 150, 200)),
    "capitals": ("n_capitals", "word_chars", (20, 30, 40, 50, 60, 70, 80)),
    "exclamations": ("n_exclamations", "n_words", (20, 40, 60, 80, 100, 150, 200)),
    "dup_lines": ("n_dup_lines", "n_lines", (20, 30, 40, 50, 60, 70, 80)),
    "word_length": ("word_chars", "n_words", (800, 900, 1000, 1200, 1500, 2000, 3000)),
}
#: Strata up to this number go to every executor; more are joined by shuffle.
MAX_BROADCAST_STRATA = 10_000
#: Labelled doc_ids up to this number go to every executor, so that only labelled texts get features for the cutoffs;
#: beyond it all do, and numbers are joined by shuffle.
MAX_BROADCAST_LABELS = 2_000_000


def _count(chars: str) -> Column:
    """Characters of the text in the class ``chars``; runs of others go at once."""
    return F.char_length(F.regexp_replace("__text", f"[^{chars}]+", "")).cast("bigint")


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the features that need no windows; null texts count as empty."""
    docs = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    docs = docs.withColumn("__words", F.array_remove(F.split("__text", "[ \\x09-\\x0D]+"), ""))
    docs = docs.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")))
    return docs.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": _count("#*$%&|<>"),
            "n_capitals": _count("A-Z"),
            "n_exclamations": _count("!"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        }
    )


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 8-word windows found twice or more in the text.

    A window's 64-bit hash comes from those of its halves, three times over, so each word is hashed once.
    Texts whose windows all differ, the usual case, skip the sort.
    """
    docs = docs.withColumn("__h1", F.when(F.size("__words") >= 8, F.transform("__words", lambda w: F.xxhash64(w))))
    for n in (1, 2, 4):
        h, size = f"__h{n}", F.size(f"__h{n}") - n
        docs = docs.withColumn(f"__h{2 * n}", F.zip_with(F.slice(h, 1, size), F.slice(h, n + 1, size), lambda a, b: F.xxhash64(a, b)))
    sort = F.array_sort(F.transform("__h8", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    docs = docs.withColumn("__s", F.when(F.size(F.array_distinct("__h8")) < F.size("__h8"), sort))
    pairs = F.zip_with(F.slice("__s", 1, F.size("__s") - 1), F.slice("__s", 2, F.size("__s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    docs = docs.withColumn("__p", F.when(F.col("__s").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last"))
    count = F.aggregate("__p", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(8), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return docs.withColumn("n_repeat_words", F.coalesce(count, F.lit(0)).cast("bigint"))


def exceeds(rule: str, cutoff: Column) -> Column:
    part, whole, _ = RULES[rule]
    return F.coalesce(F.col(part) * 100 > cutoff * F.col(whole), F.lit(False))


def tail(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k) for k up to the mean; 1 beyond it."""
    odds = math.log(risk / (1 - risk))
    none = n * math.log(1 - risk)
    start = F.struct(none.alias("p"), none.alias("s"))

    def step(a: Column, j: Column) -> Column:
        p = a["p"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(a["s"], p), F.least(a["s"], p)
        return F.struct(p.alias("p"), (high + F.log1p(F.exp(low - high))).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(k > n * risk, 1.0).otherwise(F.exp(F.aggregate(steps, start, step, lambda a: a["s"])))


def labelled(docs: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """(doc_id, stratum, good, held_out, the rules' features), a row for each labelled document.

    Repeated labels count once, documents with labels of both kinds not at all; of rows that repeat a
    doc_id one counts.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"), F.max("quality").cast("int").alias("other")).where("good = other").drop("other")
    marks = written(marks, "labels")
    docs = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    inputs = sorted({c for part, whole, _ in RULES.values() for c in (part, whole)})
    if marks.count() <= MAX_BROADCAST_LABELS:
        found = features(docs.join(F.broadcast(marks), "doc_id")).select("doc_id", "good", "stratum", *inputs)
    else:
        found = features(docs).select("doc_id", "stratum", *inputs).join(marks, "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct("good", "stratum", *inputs)).alias("x")).select("doc_id", "x.*")
    return one.withColumn("held_out", F.md5(F.col("doc_id").cast("string").cast("binary")) < "8")


def cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, a column of cutoffs for each rule): the proven rules' cutoffs, or null."""
    marked = written(labelled(docs, labels, stratum), "labelled")
    n_strata = marked.select("stratum").distinct().count()
    # a document's level: how many of a rule's ascending cutoffs it exceeds
    levels = F.array(*(F.struct(F.lit(rule).alias("rule"), sum((exceeds(rule, F.lit(c)).cast("int") for c in grid), F.lit(0)).alias("level")) for rule, (_, _, grid) in RULES.items()))
    counts = marked.where("not held_out").select("stratum", "good", F.explode(levels).alias("x")).groupBy("stratum", "x.rule", "x.level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    grids = F.create_map(*(x for rule, (_, _, grid) in RULES.items() for x in (F.lit(rule), F.array(*map(F.lit, grid)))))
    over = F.col("level") > F.col("i")
    rows = counts.select("*", F.posexplode(grids[F.col("rule")]).alias("i", "cutoff")).groupBy("stratum", "rule", "cutoff").agg((F.sum(F.when(over, F.col("bad")).otherwise(0)) - GOOD_WEIGHT * F.sum(F.when(over, F.col("good")).otherwise(0))).alias("gain")).where("gain > 0")
    best = rows.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("x")).select("stratum", "rule", "x.*")
    best = best.withColumn("step", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), "rule")))
    plan = best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{name}_{r}") for r in RULES for name, c in (("cut", "cutoff"), ("step", "step"))))
    plan = written(plan, "proposed-cutoffs")
    tested = marked.where("held_out and good = 1").join(plan, "stratum")
    first = F.least(*(F.when(exceeds(r, F.col(f"cut_{r}")), F.col(f"step_{r}")) for r in RULES))
    steps = range(1, len(RULES) + 1)
    tested = tested.withColumn("first", first).groupBy("stratum").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("first") <= j, True)).alias(f"k{j}") for j in steps))
    last = F.greatest(F.lit(0), *(F.when(tail(F.col("n"), F.col(f"k{j}"), risk) <= F.lit(error) / n_strata, j) for j in steps))
    return plan.join(tested.select("stratum", last.alias("last")), "stratum").select("stratum", *(F.when(F.col(f"step_{r}") <= F.col("last"), F.col(f"cut_{r}")).alias(f"cut_{r}") for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Base rule: under 20 words, or over 30 % of words in repeated windows.  A null stratum is one of its
    own; null and empty texts have no words and fail; labels without a document or a quality of 0 or 1 are
    left out, repeated labels count once, and documents with both labels not at all; repeated rows are
    judged alike, and an empty table gives an empty result.  A very long text is one row, judged whole.
    Columns of the input with these names are replaced.
    """
    own, back = apart(docs, ("doc_id", "text", stratum))
    found, made = _judged(own, labels, stratum, risk, error), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(*(b for c, b in zip(docs.columns, back, strict=True) if c not in made), *made)


def kept_rows(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their own columns alone."""
    own, back = apart(docs, ("doc_id", "text", stratum))
    judged = _judged(own, labels, stratum, risk, error)
    # a filter would be pushed below the features and repeat their expressions; a generator stays above them
    return judged.select(F.explode(F.when(F.col("kept"), F.array(F.struct(*back)))).alias("__row")).select("__row.*")


def _judged(docs: DataFrame, labels: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """``docs``, whose columns clash with no helper's, with the features and verdicts of ``judged``."""
    columns = docs.columns
    found = written(cutoffs(docs, labels, stratum, risk, error).withColumnRenamed("stratum", "__stratum"), "cutoffs")
    strata = F.broadcast(found) if found.count() <= MAX_BROADCAST_STRATA else found
    out = repeated_words(features(docs)).withColumn("__in", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    out = out.join(strata, F.col("__in") == F.col("__stratum"), "left")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | exceeds(rule, F.col(f"cut_{rule}"))
    return out.select(*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def _oracle() -> str:
    tests = " UNION ALL ".join(f"SELECT stratum, '{rule}' AS rule, {c} AS cutoff, CAST(count(*) FILTER (good = 0 AND {part} * 100 > {c} * {whole}) - {GOOD_WEIGHT} * count(*) FILTER (good = 1 AND {part} * 100 > {c} * {whole}) AS BIGINT) AS gain FROM marked WHERE NOT held_out GROUP BY stratum" for rule, (part, whole, grid) in RULES.items() for c in grid)
    hits = " OR ".join(f"(b.rule = '{rule}' AND f.{part} * 100 > b.cutoff * f.{whole})" for rule, (part, whole, _) in RULES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
s AS (SELECT doc_id, unnest(range(0, len(words) - 7)) AS p, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i : i + 7], ' '))) AS s FROM w WHERE len(words) >= 8),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, p - coalesce(last, -8))) AS n FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, d.stratum, CAST(len(w.words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(length(d.text) - length(replace(d.text, '!', '')) AS BIGINT) AS n_exclamations,
  CAST(coalesce(lines.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
marked AS (SELECT f.*, marks.good, md5(CAST(doc_id AS VARCHAR)) < '8' AS held_out FROM f JOIN marks USING (doc_id)),
strata AS (SELECT count(DISTINCT stratum) AS n FROM marked),
t AS ({tests}),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS step
  FROM (SELECT stratum, rule, arg_max(cutoff, gain * 10000 + cutoff) AS cutoff, max(gain) AS gain FROM t WHERE gain > 0 GROUP BY stratum, rule)),
held AS (SELECT f.stratum, f.doc_id, min(b.step) FILTER ({hits}) AS first FROM marked f JOIN best b USING (stratum) WHERE f.held_out AND f.good = 1 GROUP BY f.stratum, f.doc_id),
steps AS (SELECT h.stratum, j.j, count(*) AS n, count(*) FILTER (h.first <= j.j) AS k FROM held h, (SELECT unnest(range(1, {len(RULES) + 1})) AS j) j GROUP BY h.stratum, j.j),
p AS (SELECT *, CASE WHEN k > n * {RISK} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS tail FROM steps),
used AS (SELECT b.* FROM best b JOIN (SELECT stratum, max(j) AS last FROM p WHERE tail <= {ERROR} / (SELECT n FROM strata) GROUP BY stratum) q ON b.stratum = q.stratum AND b.step <= q.last)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT EXISTS (SELECT 1 FROM used b WHERE b.stratum = f.stratum AND ({hits})) AS kept
FROM f
"""


ORACLE_SQL = _oracle()
