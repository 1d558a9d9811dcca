"""Host-level quality rules, in DataFrame functions alone.

Each document is measured and held against every rule. Failures are summed by host (source) and rule; a host's rate of
a rule is shrunk by a beta prior fitted to all hosts (moments weighted by documents, less the spread that sampling alone
gives); the host's verdicts go back to its documents:

* the base rules (too few words, too many repeated ones) decide for each document, and a host whose shrunk rate of
  base failures is above its limit loses all its documents;
* the soft rules (symbols, repeated lines, single letters for words) can be met by good documents, so a failure counts only
  on hosts where failures of that rule are common: where the shrunk rate is above the rule's limit.

Null texts count as empty (no words: they fail). A null source is a host of its own. Empty tables give empty results;
repeated rows count as often as they occur.

Windows of five words are compared by 64-bit hashes: two different windows of a text agree with a chance below
one in 10**10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, saved, small_join

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: Percent of words in repeated windows above which a document fails.
MAX_REPEATED = 20
WINDOW = 5
#: Each rule: what fails, for Spark and DuckDB alike, and the shrunk rate above which it tells on a host.
RULES = {
    "base": (f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words", 0.5),
    "symbols": ("2 * n_symbols > n_words", 0.02),
    "lines": ("10 * n_dup_lines > 3 * n_lines", 0.02),
    "letters": ("word_chars < 2 * n_words", 0.02),
}
#: A prior weighs this many documents at least, and at most where hosts differ no more than by chance.
PRIOR_DOCS = (1.0, 1000.0)


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once a row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort the windows by hash, keep those beside an equal one, and add up what each adds to those before it."""

    def overlap(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | (F.get(s, j + 1)["h"] == e["h"]))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

        def step(acc: Column, i: Column) -> Column:
            at = i.cast("long")
            return F.struct((acc["n"] + at + WINDOW - F.greatest(acc["end"], at)).alias("n"), (at + WINDOW).alias("end"))

        return F.aggregate(places, none, step)["n"]

    paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(paired, overlap))


def _word_measures(words: Column) -> Column:
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    repeats = F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, _covered))
    return F.struct(n.cast("long").alias("n_words"), repeats.alias("n_repeat_words"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
        _let(words, _word_measures).alias("_m"),
    )
    out = out.select("doc_id", "source", F.col("_m.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"), F.col("_m.n_repeat_words").alias("n_repeat_words"))
    return out.select("*", *[F.expr(rule).alias(f"{name}_failed") for name, (rule, _) in RULES.items()])


def host_verdicts(measures: DataFrame) -> DataFrame:
    """source, host_docs, and for each rule the host's shrunk rate and whether it tells. The priors need one row of sums over the hosts."""
    hosts = saved(measures.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), *[F.count_if(f"{r}_failed").alias(f"_f_{r}") for r in RULES]))
    n = F.col("host_docs")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *[F.sum(f"_f_{r}").alias(f"f_{r}") for r in RULES], *[F.sum(F.col(f"_f_{r}") * F.col(f"_f_{r}") / n).alias(f"ff_{r}") for r in RULES]).first()
    out = [F.col("source"), n]
    for r, (_, limit) in RULES.items():
        mean, weight = prior(sums["k"], sums["n"] or 0, sums["nn"] or 0, sums[f"f_{r}"] or 0, sums[f"ff_{r}"] or 0.0)
        rate = (F.col(f"_f_{r}") + F.lit(mean * weight)) / (n + F.lit(weight))
        out += [rate.alias(f"{r}_rate"), (rate > limit).alias(f"{r}_tells")]
    return hosts.select(*out)


def prior(k: int, n: int, nn: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and weight in documents of the beta prior. From k hosts: the sums of documents, of their squares, of failures, and of failures squared a document.

    The spread of rates between hosts is what is seen less what chance gives: the weight is 1 / rho - 1 for the
    correlation rho of two documents of a host.
    """
    mean = failed / n if n else 0.0
    room = n - nn / n - (k - 1) if n else 0.0
    if not 0 < mean < 1 or room <= 0:
        return mean, PRIOR_DOCS[1]
    rho = ((squares - n * mean * mean) / (mean * (1 - mean)) - (k - 1)) / room
    return mean, min(max(1 / rho - 1, PRIOR_DOCS[0]), PRIOR_DOCS[1]) if rho > 0 else PRIOR_DOCS[1]


def judge(docs: DataFrame) -> DataFrame:
    """The measures, each rule's failure, the host's rates and ``kept`` for every document."""
    measures = saved(measured(docs))
    hosts = saved(host_verdicts(measures).withColumn("_host", F.struct("source")).drop("source"))
    joined = small_join(measures.withColumn("_host", F.struct("source")), hosts, ["_host"], "left")
    soft = [r for r in RULES if r != "base"]
    kept = ~F.col("base_failed") & ~F.col("base_tells")
    for r in soft:
        kept = kept & ~(F.col(f"{r}_failed") & F.col(f"{r}_tells"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *[f"{r}_failed" for r in soft], *[F.round(f"{r}_rate", 6).alias(f"{r}_rate") for r in RULES])


def _judge_sql() -> str:
    """DuckDB's version of :func:`judge` over the table ``documents``."""
    low, high = PRIOR_DOCS
    soft = [r for r in RULES if r != "base"]
    failures = ", ".join(f"({rule}) AS {r}_failed" for r, (rule, _) in RULES.items())
    counts = ", ".join(f"count(*) FILTER ({r}_failed) AS f_{r}" for r in RULES)
    sums = ", ".join(f"sum(f_{r}) AS s_{r}, sum(f_{r} * f_{r} / docs) AS ff_{r}" for r in RULES)
    means = ", ".join(f"s_{r} / n AS m_{r}" for r in RULES)
    rhos = ", ".join(f"CASE WHEN m_{r} > 0 AND m_{r} < 1 AND n - nn / n - (k - 1) > 0 THEN ((ff_{r} - n * m_{r} * m_{r}) / (m_{r} * (1 - m_{r})) - (k - 1)) / (n - nn / n - (k - 1)) ELSE -1 END AS rho_{r}" for r in RULES)
    weights = ", ".join(f"CASE WHEN rho_{r} > 0 THEN least(greatest(1 / rho_{r} - 1, {low}), {high}) ELSE {high} END AS w_{r}" for r in RULES)
    rates = ", ".join(f"(f_{r} + m_{r} * w_{r}) / (docs + w_{r}) AS {r}_rate" for r in RULES)
    tells = " AND ".join([f"NOT base_failed AND NOT base_rate > {RULES['base'][1]}", *[f"NOT ({r}_failed AND {r}_rate > {RULES[r][1]})" for r in soft]])
    shown = ", ".join([*[f"{r}_failed" for r in soft], *[f"round({r}_rate, 6) AS {r}_rate" for r in RULES]])
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), s AS (
    SELECT rid, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i + 4], ' ')))) AS h
    FROM w WHERE len(words) >= 5
), t AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS c FROM s) WHERE c > 1
), r AS (
    SELECT rid, CAST(sum(least(5, nxt - i)) AS BIGINT) AS n
    FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM t) GROUP BY rid
), m AS (
    SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words
    FROM w LEFT JOIN r USING (rid)
), f AS (
    SELECT *, {failures} FROM m
), h AS (
    SELECT source, count(*) AS docs, {counts} FROM f GROUP BY source
), p AS (
    SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(docs) AS DOUBLE) AS n, CAST(sum(docs * docs) AS DOUBLE) AS nn, {sums} FROM h
), a AS (
    SELECT *, {means} FROM p
), c AS (
    SELECT *, {rhos} FROM a
), q AS (
    SELECT *, {weights} FROM c
), v AS (
    SELECT source, {rates} FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {tells} AS kept, {shown}
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


JUDGE_SQL = _judge_sql()
