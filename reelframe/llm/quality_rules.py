"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule is a feature and a list of candidate cutoffs fixed in advance; a document breaks the rule
where the feature exceeds the cutoff. On labelled documents of good quality that pass the base rules,
a cutoff is certified in a stratum if its false rejections k of n make a true rate above
``risk / rules`` implausible: the exact binomial tail P(Bin(n, risk / rules) <= k) is at most
``level`` divided by the number of tests (strata x rules x cutoffs, Bonferroni). So with confidence
1 - level all rules together reject at most ``risk`` of the good documents of every stratum. Among a
rule's certified cutoffs the one that parts bad from good best is used (rejected share of bad minus
rejected share of good; then the fewest false rejections, then the laxer); a rule without a certified
cutoff that helps is not applied.

Defined results: null text has no words and fails the base rules; null strata form a stratum of their
own; labels with a null id or null quality are ignored, and contradicting labels count as bad; labels
may be missing altogether, then only base rules apply; repeated rows get equal results; texts of any
length are read whole (equal windows of a text are told by a 64-bit hash); an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_small, shared, words_array

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
RISK, LEVEL = 0.05, 0.05
#: Rule: candidate cutoffs, a document breaks the rule above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3),
    "dup_line_ratio": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}


def features(docs: DataFrame, text_col: str, id_col: str, stratum_col: str | None) -> DataFrame:
    """id, stratum, counts and ratios of every document; one row each."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.col(f"`{stratum_col}`").cast("string") if stratum_col else F.lit("all")).alias("stratum"), text.alias("text"), words_array(text).alias("w"))
    n = F.size("w")
    # a hash of each three-word window; 64 bits keep chance repeats within one text out
    gram = lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    counts = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "lines"]
    d = d.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), gram)).alias("grams"),
    )
    # Each step is a projection of its own, so that none is computed anew for every element of the next.
    d = d.select(*counts, "grams", F.when(F.size("grams") > F.size(F.array_distinct("grams")), F.sort_array("grams")).alias("ordered"))
    after = F.slice("ordered", 2, F.greatest(F.size("ordered") - 1, F.lit(0)))
    twice = F.array_distinct(F.filter(F.zip_with("ordered", after, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    d = d.select(*counts, "grams", twice.alias("twice"))
    # Places of repeated windows: few repeated values are looked up, many are met by sorting (hash, place).
    looked = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains("twice", F.element_at("grams", i)))
    by_hash = F.when(F.size("twice") > 32, F.sort_array(F.zip_with("grams", F.sequence(F.lit(1), F.size("grams")), lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    d = d.select(*counts, F.when(F.size("twice") <= 32, looked).alias("looked"), by_hash.alias("by_hash"))
    after = F.slice("by_hash", 2, F.greatest(F.size("by_hash") - 1, F.lit(0)))
    met = F.flatten(F.zip_with("by_hash", after, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    places = F.when(F.col("looked").isNotNull(), F.col("looked")).otherwise(F.sort_array(F.array_distinct(met)))
    d = d.select(*counts, places.alias("places"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"].cast("long"),
    )
    n_lines = F.size("lines")
    d = d.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        n_lines.alias("n_lines"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return d.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("word_chars", "n_words").alias("word_length"),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact, summed in logarithms; 1 where k is no less than the mean."""
    odds = log(p) - log(1 - p)
    first = n * F.lit(log(1 - p))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (term + F.log1p(F.exp(s["total"] - term))).alias("total"))

    zero = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, zero, step, lambda s: F.exp(s["total"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(total)


def thresholds(found: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """One row a stratum with labelled documents: the certified cutoff of each rule, or null."""
    said = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = found.where("not base_failed").join(said, "doc_id").select("stratum", (F.col("quality") >= 1).alias("good"), *rules)
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) > c).alias("over")) for r, cuts in rules.items() for c in cuts]))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    good, over = F.col("good"), F.col("t.over")
    rows = held.select("stratum", "good", tests.alias("t")).groupBy("stratum", "t.rule", "t.cutoff")
    rows = shared(rows.agg(count(good).alias("n_good"), count(~good).alias("n_bad"), count(good & over).alias("k"), count(~good & over).alias("hit")), "rule-tests")
    m = max(1, rows.count())  # strata x rules x cutoffs
    gain = F.col("hit") / F.greatest("n_bad", F.lit(1)) - F.col("k") / F.greatest("n_good", F.lit(1))
    passed = rows.withColumn("p", binomial_tail(F.col("n_good"), F.col("k"), risk / len(rules))).where(F.col("p") <= level / m).withColumn("gain", gain).where("gain > 0")
    best = passed.groupBy("stratum", "rule").agg(F.max(F.struct("gain", (-F.col("k")).alias("few"), "cutoff")).alias("b"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("b.cutoff"))).alias(f"{r}_cut") for r in rules])


def quality_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str | None = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Features, base verdict, verdict of each rule and ``kept`` for every document.

    ``stratum_col`` None: all documents are one stratum.
    """
    found = shared(features(docs, text_col, id_col, stratum_col), "rule-features")
    cuts = shared(thresholds(found, labels, risk, level), "rule-cutoffs").withColumnRenamed("stratum", "cut_stratum")
    out = join_small(found, cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")))
    broken = {r: F.coalesce(F.col(r) > F.col(f"{r}_cut"), F.lit(False)) for r in RULES}
    failed = F.lit(False)
    for b in broken.values():
        failed = failed | b
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~failed).alias("kept"), *[b.alias(f"over_{r}") for r, b in broken.items()],
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, labels)


#: Risk of the query over one stratum: loose enough for cutoffs to be certified on a few hundred labels.
POOLED_RISK = 0.25


def pooled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same rules over one stratum at a higher risk, for small labelled sets."""
    return quality_rules(docs, labels, stratum_col=None, risk=POOLED_RISK)


_W = r"[^\x20\x09-\x0D]+"
_CASES = ", ".join(f"('{r}', {c!r}::DOUBLE)" for r, cuts in RULES.items() for c in cuts)
def oracle(stratum: str = "lang", risk: float = RISK) -> str:
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, {stratum} AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, text, regexp_extract_all(text, '{_W}') AS w FROM t),
g AS (SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT i + d) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g), (VALUES (0), (1), (2)) AS v(d) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM w),
b AS (SELECT w.rid, doc_id, lang, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
             len(l.l) AS n_lines, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
             n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS word_length FROM b),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT lang, quality >= 1 AS good, unnest([{", ".join(f"{{'rule': '{r}', 'x': {r}::DOUBLE}}" for r in RULES)}]) AS u FROM f JOIN q USING (doc_id) WHERE NOT base_failed),
s AS (SELECT lang, c.rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb,
             count(*) FILTER (good AND u.x > cutoff) AS k, count(*) FILTER (NOT good AND u.x > cutoff) AS hit
      FROM h JOIN (VALUES {_CASES}) AS c(rule, cutoff) ON u.rule = c.rule GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {risk / len(RULES)!r} THEN 1.0 ELSE
             (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({risk / len(RULES)!r}) + (n - i) * ln(1 - {risk / len(RULES)!r}))) FROM unnest(range(0, k + 1)) AS x(i)) END AS p,
             hit / greatest(nb, 1) - k / greatest(n, 1) AS gain, (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM h) * {sum(map(len, RULES.values()))} AS m FROM s),
c AS (SELECT lang, rule, cutoff, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, k, cutoff DESC) AS place FROM p WHERE p <= {LEVEL} / m AND gain > 0),
v AS (SELECT f.*, {", ".join(f"coalesce({r} > (SELECT cutoff FROM c WHERE place = 1 AND rule = '{r}' AND c.lang IS NOT DISTINCT FROM f.lang), false) AS over_{r}" for r in RULES)} FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(f"over_{r}" for r in RULES)}) AS kept, {", ".join(f"over_{r}" for r in RULES)}
FROM v
"""


ORACLE_SQL = oracle()
POOLED_SQL = oracle("'all'", POOLED_RISK)
