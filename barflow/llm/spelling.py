"""Spelling variants of the corpus's words, found through an index of variable-length grams (Li, Wang and Yang, 2007).

A word stands between two marks, ``^word$``. At every place it has the shortest gram that is rare, so a gram is extended only while
it is frequent: the dictionary of frequent grams is closed under prefixes, and what a place's gram is depends on that gram's own
characters alone. An edit therefore destroys no grams but those that cover it. With m grams of which the most crowded place is
covered by a, any word at one edit holds m - a of them at the same place from the left or from the right. Of the a + 1 rarest
grams (ties whole) one survives in both words' lists: only these short lists are merged, the long ones never. ``^word$`` has one
gram a place and a gram has no more characters than the shortest word, so m > a holds for all words and no pair can be lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barflow.llm.session import bounded, checkpointed
from barflow.llm.sql import crc32_of

#: Least characters and occurrences of a word, how often a gram's word count must exceed its variant's, and which runs the query damages.
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 6, 5, 5, 199
#: Characters of a gram, least and most, and how many places a gram may have before it is extended.
SHORTEST, LONGEST, FREQUENT = 2, 6, 200
#: Characters of words whose distance the built-in function takes.
SHORT = 64
_LETTERS = "a-zÀ-ÿ"


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, run) of every maximal run of letters with at least so many of them, A-Z in lower case. Null texts have none."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"[{_LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))


def damaged(doc_id: Column, run: Column, every: int = DAMAGED) -> Column:
    """``run``, without one character where the crc32 of ``<doc_id>:<run>`` is divisible by ``every``; a null id counts as an empty one."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the values of ``words(word)`` with at least so many characters and occurrences."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def grams(words: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(id, p, gram, covered) of ``words(id, word)``: each place's gram of the dictionary, and how many grams cover that place."""
    cell = F.regexp_extract_all(F.concat(F.lit("^"), "word", F.lit("$")), F.lit(f"(?=(.{{{SHORTEST},{longest}}}))"), F.lit(1))
    cells = words.select("id", F.posexplode(cell).alias("p", "g"))
    lengths = [q for q in range(SHORTEST, longest)]
    prefixes = F.array(*[F.when(F.char_length("g") > q, F.substring("g", 1, q)) for q in lengths])
    inner = cells.select(F.explode(prefixes).alias("f")).where("f is not null").groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > frequent)
    inner = bounded(inner.select("f", F.lit(1).alias("more")), 200_000)
    for q in lengths:
        name = f"more{q}"
        cells = cells.join(inner.withColumnsRenamed({"f": f"f{q}", "more": name}), (F.substring("g", 1, q) == F.col(f"f{q}")) & (F.char_length("g") > q), "left").drop(f"f{q}")
    size = F.lit(SHORTEST) + sum((F.coalesce(f"more{q}", F.lit(0)) for q in lengths), F.lit(0))
    cells = cells.select("id", "p", F.substring(F.col("g"), F.lit(1), size).alias("gram"), size.alias("q"))
    order = Window.partitionBy("id").orderBy("p")
    return cells.select("id", "p", "gram", sum(((F.coalesce(F.lag("q", d).over(order), F.lit(0)) > d).cast("int") for d in range(longest)), F.lit(0)).alias("covered"))


def short_lists(words: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(id, p, gram) of each word's rarest grams: one more than an edit can destroy, and all that are as rare and equal."""
    cells = checkpointed(grams(words, frequent, longest))
    often = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("id").orderBy("often", "gram")
    ranked = cells.join(often, "gram").select("id", "p", "gram", F.rank().over(order).alias("nth"), F.max("covered").over(Window.partitionBy("id")).alias("destroyed"))
    return ranked.where(F.col("nth") <= F.col("destroyed") + 1).select("id", "p", "gram")


def near_pairs(words: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(a, b), ids of ``words(id, word)`` that differ by exactly one inserted, deleted or replaced character; a is shorter, or less.

    ``id`` and ``word`` are unique and no word has fewer than ``longest`` characters. Lists meet by gram, place and length at once, so a
    frequent gram is as many keys as it has places and lengths. No words give no pairs.
    """
    # a word's set of letters as 64 bits: one edit changes at most two of them
    letters = F.expr("aggregate(array_distinct(split(word, '')), 0L, (a, c) -> a | shiftleft(1L, ascii(c) % 64))")
    facts = words.select("id", F.char_length("word").alias("size"), letters.alias("letters"))
    lists = checkpointed(short_lists(words, frequent, longest).join(facts, "id"))
    # a replaced character leaves all places; an inserted one moves those behind it
    keys = F.array(*[F.struct((F.col("p") + i).alias("p"), (F.col("size") + j).alias("size")) for i, j in ((0, 0), (0, 1), (1, 1))])
    left = lists.select(F.col("id").alias("a"), F.col("size").alias("a_size"), F.col("letters").alias("a_letters"), "gram", F.explode(keys).alias("k")).select("a", "a_size", "a_letters", "gram", "k.p", "k.size")
    met = left.join(lists, ["gram", "p", "size"]).where("(a_size < size or a < id) and bit_count(a_letters ^ letters) <= 2").select("a", F.col("id").alias("b")).distinct()
    of = lambda name: words.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"))
    # the built-in distance takes time by the product of the lengths: long words are compared from their first difference on
    at = F.expr("array_position(zip_with(split(a_word, ''), split(b_word, ''), (x, y) -> NOT x <=> y), true)").cast("int")
    rest = lambda c, i: F.substring(F.col(c), i, F.char_length(c))
    linear = F.when(F.char_length("a_word") == F.char_length("b_word"), rest("a_word", at + 1) == rest("b_word", at + 1)).otherwise(rest("a_word", at) == rest("b_word", at + 1))
    near = F.when(F.char_length("b_word") <= SHORT, F.levenshtein("a_word", "b_word", 1) == 1).otherwise(linear)
    return met.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b")


def grouped(words: DataFrame, ratio: int = RATIO, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words(word, n)``.

    A word's near words differ from it by one character; its form is the one of largest n (ties: the least in code-point order) where
    that n is at least ``ratio`` times its own, and root is where following forms ends. Words are unique and have ``longest`` characters or
    more; other words raise an error. Each form has ``ratio`` times the occurrences, so paths are short and each round halves them. No
    words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms end")
    words = checkpointed(words.select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")))
    if words.where(F.char_length("word") < longest).limit(1).count():
        raise ValueError(f"all words must have {longest} characters or more")
    pairs = checkpointed(near_pairs(words.select("id", "word"), frequent, longest))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("near")))
    near = words.select(F.col("id").alias("near"), F.struct((-F.col("n")).alias("n"), "word").alias("rank"))
    best = both.join(near, "near").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("rank").alias("best"))
    formed = F.col("best.n") <= -ratio * F.col("n")
    out = words.join(best, "id", "left").select("word", F.when(formed, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.n")).alias("form_n"))
    out = checkpointed(out)
    roots = checkpointed(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = checkpointed(step)
        moved, roots = step.where("moved").limit(1).count(), step.drop("moved")
        if not moved:
            return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """``grouped`` of the words of ``docs(doc_id, text)``: maximal runs of Latin letters, counted over all whole texts. With ``damage``, one
    run in so many loses a character first. Null, empty and letterless texts have no words; repeated rows count each; one run of any length
    is one word; other columns are not read; an empty table gives no rows."""
    found = runs(docs)
    return grouped(counted(found.select((damaged(F.col("doc_id"), F.col("run"), damage) if damage else F.col("run")).alias("word"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), DAMAGED)


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {
    "op12_spelling_variants": f"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_LETTERS}]{{{LEAST_LENGTH},}}')) AS run
  FROM documents),
h AS (SELECT run, {crc32_of("concat(doc_id, ':', run)")} AS h FROM t),
w AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % {DAMAGED} = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word FROM h)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
d AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
p AS (
  SELECT a.word, b.word AS near FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
m AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS nth
  FROM p JOIN w ON w.word = p.near),
f AS (
  SELECT w.word, w.n, CASE WHEN m.near_n >= {RATIO} * w.n THEN m.near END AS form, CASE WHEN m.near_n >= {RATIO} * w.n THEN m.near_n END AS form_n, coalesce(m.n_near, 0) AS n_near
  FROM w LEFT JOIN m ON m.word = w.word AND m.nth = 1),
r AS (
  SELECT word, form AS root FROM f WHERE form IS NOT NULL
  UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f LEFT JOIN e ON e.word = f.word"""
}
