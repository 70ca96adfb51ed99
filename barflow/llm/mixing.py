"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barflow.llm.session import checkpointed, fresh

#: Rows that one node of the reduction tree folds, about.
FANOUT = 128
#: Sizes in words from which documents are rounded first, second, ...; the rest come last.
CLASSES = (512, 128)
_EPS = 1e-9


def n_words(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``sizes(source, n, source_size)`` with target: shares of the total by weight, none above ``most`` times its size.

    Weights repeat over the sources by code point, null last. What a cap cuts off is shared again among the
    others by weight until none is above: target = min(cap, level * weight), with the level found from the sources in
    the order of cap / weight. The windows see one row per source; this table is a dimension, not data.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level_here", left / F.sum("weight").over(after))
    fits = F.col("level_here") * F.col("weight") <= F.col("cap") * (1 + 1e-12)
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("level_here").alias("level")))).over(Window.partitionBy())["level"]
    return ranked.withColumn("level", level).select("source", "n", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _fold(level: int, seed: int) -> Column:
    """Fold ``rows`` (sorted structs k, size, p): each step pairs the open row with the next one, and one of them is decided.

    Mass moves so that the sum of size * p stays and each p stays the expected value: up for one and down for the other,
    as far as one of them gets to 0 or 1, in either direction with the odds that keep the expectation.
    """

    def step(state: Column, x: Column) -> Column:
        o = state["open"]
        ratio = x["size"] / o["size"]  # a change of x by d is a change of the open row by -d * ratio
        up, down = F.least(1 - x["p"], o["p"] / ratio), F.least(x["p"], (1 - o["p"]) / ratio)
        d = F.when(uniform(F.lit(seed), F.lit(level), o["k"], x["k"]) * (up + down) < down, up).otherwise(-down)
        px, po = x["p"] + d, o["p"] - d * ratio
        whole = lambda p: (p < _EPS) | (p > 1 - _EPS)
        row = lambda r, p: F.struct(r["k"].alias("k"), r["size"].alias("size"), p.alias("p"))
        moved = F.when(whole(px), F.struct(row(o, po).alias("open"), row(x, F.round(px)).alias("closed"))).otherwise(F.struct(row(x, px).alias("open"), row(o, F.round(po)).alias("closed")))
        moved = F.when(whole(o["p"]), F.struct(x.alias("open"), row(o, F.round(o["p"])).alias("closed"))).otherwise(moved)
        # the two fields must come from one evaluation: wrap and unwrap
        return F.element_at(
            F.transform(F.array(moved), lambda m: F.struct(m["open"].alias("open"), F.concat(state["done"], F.array(m["closed"])).alias("done"))), 1
        )

    first = F.element_at("rows", 1)
    empty = F.slice("rows", 1, 0)
    return F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.struct(first.alias("open"), empty.alias("done")), step)


def pivotal(rows: DataFrame, total: int, seed: int = 0, fanout: int = FANOUT) -> DataFrame:
    """``rows(stratum, k, size double > 0, p)`` rounded to (stratum, k, size, up 0 or 1); ``total``: rows of the largest stratum.

    A reduction tree: rows are dealt to nodes of about ``fanout`` rows by a hash of their key, a node folds its rows
    and hands on the one that is left open, and the open rows of all nodes go through the next level. The number of
    rows shrinks by the fan-out each level. Per stratum, the sum of size * p is kept but for the last open row, which is
    rounded by its p: one of the largest, since the smaller one of a pair is decided first.
    """
    nodes, level, decided, last = total, 0, [], False
    while not last:
        nodes = -(-nodes // fanout)
        last = nodes <= 1
        node = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "k"), F.lit(max(nodes, 1)))
        grouped = rows.groupBy("stratum", node.alias("node")).agg(F.sort_array(F.collect_list(F.struct("k", "size", "p"))).alias("rows"))
        folded = grouped.select("stratum", _fold(level, seed).alias("f"))
        folded = checkpointed(folded.select("stratum", F.col("f.open").alias("o"), F.col("f.done").alias("done")))
        decided.append(folded.select("stratum", F.explode("done").alias("r")).select("stratum", "r.k", "r.size", F.col("r.p").cast("long").alias("up")))
        rows = folded.select("stratum", "o.k", "o.size", "o.p")
        level += 1
    decided.append(rows.select("stratum", "k", "size", (uniform(F.lit(seed), F.lit(-1), "k") < F.col("p")).cast("long").alias("up")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def by_size(rows: DataFrame, total: int, seed: int = 0, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """``rows(stratum, k, size, want, most)`` as (stratum, k, copies): ``want`` rounded up or down, large documents first.

    What the last open row of a class is off by is made up for in the next: its wants are shifted alike for the whole stratum by the words
    that are owed, over whole copies too but never below 0 or above ``most``, and then their fractions are rounded by ``pivotal``. So a stratum's
    words differ from the expected ones by less than the largest document of its smallest class, as long as the smaller classes have words
    enough.
    """
    owed, out, above = None, None, None
    for least in (*classes, 0):
        part = rows.where(F.col("size") >= least) if above is None else rows.where((F.col("size") >= least) & (F.col("size") < above))
        above = least
        sums = part.groupBy("stratum").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("want")).alias("wanted"))
        sums = sums.withColumn("error", F.lit(0.0)) if owed is None else sums.join(owed, "stratum", "full").na.fill(0.0)
        sums = checkpointed(sums)
        shifted = part.join(F.broadcast(sums) if sums.count() <= 10_000 else sums, "stratum").withColumn("want", F.greatest(F.lit(0.0), F.least("most", F.col("want") - F.col("error") / F.col("words"))))
        shifted = shifted.withColumn("base", F.floor(F.col("want") + _EPS)).withColumn("p", F.greatest(F.col("want") - F.col("base"), F.lit(0.0)))
        shifted = checkpointed(shifted.select("stratum", "k", "size", "base", "p"))
        up = pivotal(shifted.where(F.col("p") > _EPS).select("stratum", "k", "size", "p"), total, seed + least)
        copies = F.col("base") + F.coalesce("up", F.lit(0).cast("long"))
        found = checkpointed(shifted.join(up.select("stratum", "k", "up"), ["stratum", "k"], "left").select("stratum", "k", "size", copies.alias("copies")))
        got = found.groupBy("stratum").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
        owed = sums.join(got, "stratum", "left").select("stratum", (F.coalesce("got", F.lit(0.0)) - F.col("wanted") + F.col("error")).alias("error"))
        out = found if out is None else out.unionByName(found)
    return out.select("stratum", "k", "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies): how often each document goes into the mix.

    A document of a source with target / source_size = r is taken floor(r) or floor(r) + 1 times; small ones a copy more or less where
    that makes up for what large ones are off by, never more than ``most`` times. Which ones get the extra copy is found by ``pivotal`` with
    the sizes in words as weights (``by_size``), so that the words of a source with small documents enough differ from its target by less
    than one of them; of one without, by less than its largest document.

    Rows with the same doc_id, source and size count as ``rows`` rows of one entry and share its copies; this also
    holds a null doc_id. Null and empty texts have size 0: they move no words and are rounded on their own.
    A null source is a source. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = checkpointed(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = checkpointed(targets(sizes, weights, most))
    total = goal.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"]).withColumn("want", rate * F.col("rows"))
    named = named.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("k", F.coalesce(F.concat_ws(":", F.col("doc_id").cast("string"), "size"), F.lit("")))
    # a document's own weight is its size; that of an entry of m rows is still the words of one more copy
    sized = named.where("size > 0").select("stratum", "k", F.col("size").cast("double").alias("size"), "want", (F.lit(float(most)) * F.col("rows")).alias("most"))
    named = named.join(by_size(sized, total, seed), ["stratum", "k"], "left")
    chance = F.floor(F.col("want") + _EPS) + (uniform(F.lit(seed), F.lit(-2), "k") < F.col("want") - F.floor(F.col("want") + _EPS)).cast("long")
    return named.select("doc_id", "source", "size", "rows", "source_size", "target", F.coalesce("copies", chance).alias("copies"))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; an entry of several rows shares its copies evenly, the first ones getting one more."""
    plan = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("nth")
    share = F.expr("copies div rows") + (F.col("nth") < F.col("copies") % F.col("rows")).cast("long")
    return plan.select("*", nth).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (share * F.col("size")).alias("taken"), "source", share.alias("copies"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 0, copy_col: str = "copy") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the number of the copy in ``copy_col``.

    Rows that share doc_id, source and size take turns at their entry's copies, by a hash of the text. Null ids, sources and
    texts are values like any other; a text of no words is taken by chance at its source's rate; an empty table gives no
    rows. All columns stay, but for one named ``copy_col``, which is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != copy_col.lower()]
    own, rows, taken, nth, share = fresh([*columns, copy_col], "own", "rows", "taken", "nth", "share")
    plan = mixed(docs.select("doc_id", "source", "text"), weights, most, seed).where("copies > 0")
    plan = plan.select(F.struct("doc_id", "source", "size").alias("entry"), F.col("rows").alias(rows), F.col("copies").alias(taken))
    # the entry as one struct: null fields compare as equal, and no column of docs can clash
    keyed = docs.select(*columns, F.struct("doc_id", "source", n_words(F.col("text")).alias("size")).alias(own))
    found = keyed.join(plan, keyed[own] == plan["entry"]).drop("entry")
    once = found.where(F.col(rows) == 1).withColumn(share, F.col(taken))
    order = Window.partitionBy(own).orderBy(F.xxhash64("text"))
    more = found.where(F.col(rows) > 1).withColumn(nth, F.row_number().over(order) - 1)
    turn = F.floor(F.col(taken) / F.col(rows)) + (F.col(nth) < F.col(taken) % F.col(rows)).cast("long")
    more = more.withColumn(share, turn.cast("long")).drop(nth)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(share))).alias(copy_col)
    return once.unionByName(more).where(F.col(share) > 0).select(*columns, copies)


QUERIES = {"op2_pivotal_mixing": op2_pivotal_mixing}
ORACLES: dict[str, str] = {}
