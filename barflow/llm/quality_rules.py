"""Quality rules as a short-circuit cascade, in DataFrame operations only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barflow.llm.session import checkpointed

#: Rows, about, on which the rules' costs and selectivities are estimated; jobs that are timed for each, and the least cost in seconds.
SAMPLE_ROWS, REPEATS, LEAST_SECONDS = 2000, 3, 1e-3


@dataclass(frozen=True)
class Rule:
    """``rejects``: a condition over the columns of ``measured``; null counts as no rejection."""

    name: str
    rejects: Column


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the base measures of every whole text, with its words in ``w`` for rules that look further.

    Words are runs of characters other than 0x20 and 0x09-0x0D; a null text has none. Windows of three words are
    compared by a 64-bit hash chained over the words. All work on a text is linear but for one sort of its windows,
    which only texts with a repeated window get.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("w", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.withColumn("h", windows)
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(repeated, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twin = lambda x, at: F.coalesce(F.get("s", at)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("s", lambda x, i: twin(x, i - 1) | twin(x, i + 1)), lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("text", "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("s").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "w",
    )


def default_rules() -> list[Rule]:
    """Rules for the verdict, over counts that are at hand and over the words themselves."""
    over = lambda test, share: F.size(F.filter("w", test)) > share * F.col("n_words")
    return [
        Rule("symbols", F.col("n_symbols") > 0.1 * F.col("n_words")),
        Rule("word length", (F.col("word_chars") < 2.5 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
        Rule("repeated lines", F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        Rule("repeated words", F.col("n_repeat_words") > 0.4 * F.col("n_words")),
        Rule("words without a letter", over(lambda x: ~x.rlike(r"\p{L}"), 0.2)),
        Rule("few different words", F.size(F.array_distinct("w")) < 2 * F.sqrt("n_words")),
        Rule("word repeated at once", over(lambda x, i: (i > 0) & (x == F.get("w", i - 1)), 0.2)),
    ]


def seconds(sample: DataFrame, test: Column, repeats: int) -> float:
    """The median time of a job that counts the rows of ``sample`` for which ``test`` holds."""
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        sample.agg(F.count_if(test)).first()
        took.append(time.perf_counter() - began)
    return sorted(took)[repeats // 2]


def ordered(rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS, among: Column | None = None) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in the order in which they are to be tried, as found on those of about ``sample_rows`` of ``rows``
    for which ``among`` holds.

    A rule's cost is the median time of a few jobs above that of a job with no rule; the first job of each, in which Spark compiles
    it, doesn't count. Rules are picked one by one: the one that rejects most per cost of what those before it let through, and
    its share is of these. The sample only decides the order; what a cascade returns doesn't depend on it. Ties keep the given
    order. Rows are chosen by a hash of their id; a table without rows leaves the order as given.
    """
    total = rows.select("doc_id").count()
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("cascade"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = checkpointed(rows.where(chance < sample_rows / max(total, 1)).limit(2 * sample_rows))
    sample = sample if among is None else sample.where(among)  # over what is written: a filter before would repeat the measures
    idle, costs = None, []
    for test in (F.lit(False), *[rule.rejects for rule in rules]):
        seconds(sample, test, 1)
        took = seconds(sample, test, repeats)
        idle = took if idle is None else idle
        costs.append(max(took - idle, LEAST_SECONDS))
    out = sample.select(*[F.coalesce(rule.rejects, F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]).collect()
    found, open_rules, left = [], list(range(len(rules))), [tuple(r) for r in out]
    while open_rules:
        rejected = {i: sum(r[i] for r in left) for i in open_rules}
        best = max(open_rules, key=lambda i: (rejected[i] / costs[i + 1], -i))
        found.append((rules[best], costs[best + 1], rejected[best] / len(left) if left else 0.0))
        left = [r for r in left if not r[best]]
        open_rules.remove(best)
    return found


def cascade(rules: list[Rule]) -> Column:
    """Whether a row passes all rules; a rule is evaluated only for rows that all rules before it let through."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures, base_failed and kept of every row of ``docs(doc_id, text)``.

    base_failed: fewer than 50 words, or over half of them in repeated windows. kept: neither base_failed nor rejected by
    a rule. Null and empty texts have no words and fail; repeated rows are judged each; other columns are not read.
    """
    rows = measured(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    best = [rule for rule, _, _ in ordered(rows, rules or default_rules(), sample_rows, among=~base)]
    kept = F.when(base, F.lit(False)).otherwise(cascade(best))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_rule_cascade": op10_rule_cascade}
ORACLES = {
    "op10_rule_cascade": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, w, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(3) AS o(k) WHERE times > 1 GROUP BY doc_id),
a AS (
  SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, m.w
  FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE NOT (
         n_symbols > 0.1 * n_words OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words
         OR n_dup_lines > 0.3 * n_lines OR n_repeat_words > 0.4 * n_words
         OR len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) > 0.2 * n_words
         OR len(list_distinct(w)) < 2 * sqrt(n_words)
         OR len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 0.2 * n_words) END AS kept
FROM b"""
}
