"""Merkle fixity audit of archive replicas: trees over ordered offset ranges, descended only where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barflow.llm.session import checkpointed

#: Children of a node; records of an archive in the query.
FANOUT, ARCHIVE = 64, 4096


def record_digest(*fields: Column) -> Column:
    """SHA-256 over the fields, each with its length before it, so that no two different records run together; null is not empty."""
    parts = [F.coalesce(F.concat(F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def leaves(records: DataFrame, fields: list[str], archive: str = "archive", offset: str = "offset") -> DataFrame:
    """(archive, node, n, digest): one leaf per offset. Several records at one offset are summed up as a multiset, whatever
    their order, in a sum that Spark takes in part before it shuffles: a hot offset is one row per task."""
    rows = records.select(F.col(archive).alias("archive"), F.col(offset).cast("long").alias("node"), record_digest(*map(F.col, fields)).alias("d"))
    words = [F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return rows.groupBy("archive", "node").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", *words).alias("d")).select("archive", "node", "n", F.unhex(F.sha2(F.concat_ws(",", F.col("n").cast("string"), "d"), 256)).alias("digest"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: each node hashes its children's numbers and digests in their order, ``fanout`` of them at most."""
    child = F.struct("node", "digest", "n")
    rows = nodes.groupBy("archive", F.floor(F.col("node") / fanout).alias("node")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), F.hex(x["digest"]))), ",")
    return rows.select("archive", "node", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), F.unhex(F.sha2(text, 256)).alias("digest"))


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes that one side lacks or whose digests differ."""
    a = ours.select("archive", "node", F.col("n").alias("n_expected"), F.col("digest").alias("a"))
    b = theirs.select("archive", "node", F.col("n").alias("n_found"), F.col("digest").alias("b"))
    return a.join(b, ["archive", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).drop("a", "b").na.fill(0, ["n_expected", "n_found"])


def audit(primary: DataFrame, replica: DataFrame, fields: list[str], archive: str = "archive", offset: str = "offset", fanout: int = FANOUT) -> DataFrame:
    """(archive, offset, kind, n_expected, n_found) of every offset at which ``replica`` differs from ``primary``.

    kind is missing, extra or changed. Roots are compared first; below a node only the children of differing nodes are
    read, so sound archives cost one comparison each. Offsets are whole numbers from 0 that order an archive's records.

    Nulls in the fields are values of their own. Records with a null archive or offset can't be placed in a tree: if there are any,
    one row of kind unplaced with neither tells their numbers. Repeated records count; empty tables are compared like any other;
    other columns are not read.
    """
    levels = []
    lost = [side.where(F.col(archive).isNull() | F.col(offset).isNull()).agg(F.count(F.lit(1)).alias(n)) for side, n in ((primary, "n_expected"), (replica, "n_found"))]
    unplaced = lost[0].crossJoin(F.broadcast(lost[1])).where("n_expected + n_found > 0")  # one row each
    for side in (primary, replica):
        placed = side.where(F.col(archive).isNotNull() & F.col(offset).isNotNull())
        levels.append([checkpointed(leaves(placed, fields, archive, offset))])
    highest = max((x[0].agg(F.max("node")).first()[0] or 0) for x in levels)
    while highest:
        highest //= fanout
        for x in levels:
            x.append(checkpointed(parents(x[-1], fanout)))
    ours, theirs = levels
    wrong = differing(ours[-1], theirs[-1])
    for a, b in zip(ours[-2::-1], theirs[-2::-1]):
        open_nodes = checkpointed(wrong.select("archive", F.col("node").alias("up")))
        below = [x.withColumn("up", F.floor(F.col("node") / fanout)).join(open_nodes, ["archive", "up"], "left_semi").drop("up") for x in (a, b)]
        wrong = differing(*below)
    kind = F.when(F.col("n_found") == 0, "missing").when(F.col("n_expected") == 0, "extra").otherwise("changed")
    found = wrong.select("archive", F.col("node").alias("offset"), kind.alias("kind"), "n_expected", "n_found")
    null = F.lit(None)
    return found.unionByName(unplaced.select(null.cast(dict(found.dtypes)["archive"]).alias("archive"), null.cast("long").alias("offset"), F.lit("unplaced").alias("kind"), "n_expected", "n_found"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults at fixed places: cut and altered records, lost ones, and some that were stored twice."""
    cut = pages.where("page_id % 2003 <> 7").withColumn("html", F.when(F.col("page_id") % 1009 == 5, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html")))
    cut = cut.withColumn("url", F.when(F.col("page_id") % 1511 == 3, F.concat("url", F.lit("#"))).otherwise(F.col("url")))
    return cut.unionByName(cut.where("page_id % 2503 = 11"))


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` in archives of 4,096 records by page_id, against a damaged replica of it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    placed = lambda x: x.withColumn("archive", F.floor(F.col("page_id") / ARCHIVE)).withColumn("offset", F.pmod("page_id", F.lit(ARCHIVE)))
    found = audit(placed(pages), placed(damaged(pages)), ["page_id", "url", "html"])
    return found.select((F.col("archive") * ARCHIVE + F.col("offset")).alias("page_id"), "archive", "kind", "n_expected", "n_found")


QUERIES = {"op1_merkle_fixity": op1_merkle_fixity}
ORACLES = {
    "op1_merkle_fixity": """
WITH a AS (SELECT page_id, count(*) AS n, list(concat(coalesce(url, '-'), chr(1), coalesce(html, '-')) ORDER BY url, html) AS c FROM pages WHERE page_id IS NOT NULL GROUP BY page_id),
d AS (
  SELECT page_id, CASE WHEN page_id % 1511 = 3 THEN url || '#' ELSE url END AS url,
         CASE WHEN page_id % 1009 = 5 THEN html[:length(html) - 1] ELSE html END AS html
  FROM pages WHERE page_id % 2003 <> 7),
r AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE page_id % 2503 = 11),
b AS (SELECT page_id, count(*) AS n, list(concat(coalesce(url, '-'), chr(1), coalesce(html, '-')) ORDER BY url, html) AS c FROM r GROUP BY page_id)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.page_id, b.page_id) // 4096 AS archive,
       CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'changed' END AS kind,
       coalesce(a.n, 0) AS n_expected, coalesce(b.n, 0) AS n_found
FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.c IS DISTINCT FROM b.c
UNION ALL SELECT NULL, NULL, 'unplaced', count(*), 0 FROM pages WHERE page_id IS NULL HAVING count(*) > 0"""
}
