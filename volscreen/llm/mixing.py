"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Slot i of the schedule has the golden-ratio point frac(i * phi).  The point is mapped through the
sources' cumulative target shares to a source; slots are ranked per source, and the slot of rank r
takes block r (``BLOCK`` words) of that source's shuffled word stream, which repeats when it ends.
A source's last block stops at its target; the few blocks that the finite schedule still owes a
source follow as closing slots, so the words taken differ from the target by rounding only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volscreen.llm.common import n_words, staged, table

WEIGHTS, SHARE_NUM, SHARE_DEN, REPEATS = (5, 2, 1), 3, 2, 2
#: Words in a block.
BLOCK = 256
SEED = "mix-1:"
GOLDEN = 0.6180339887498949
#: Shuffle order is cut into 2**12 cells by its leading bits, slots into runs of 2**16.
CELL_SHIFT, RUN = 48, 65536
GRID = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> idx, w, target: shares by weight, none above REPEATS times its size.

    With sources in rising order of cap / weight those that reach their cap come first; the level
    of the rest is what is left over, divided by their weights (water filling in closed form).
    """
    one = Window.partitionBy(F.lit(0))
    cap, w = F.col("source_size") * REPEATS, F.col("w")
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / w, "idx")
    before = F.coalesce(F.sum(cap).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(w).over(filled.rowsBetween(0, Window.unboundedFollowing))
    num = SHARE_NUM * F.sum("source_size").over(one) - SHARE_DEN * before
    den = SHARE_DEN * rest
    level = (
        sizes.withColumn("idx", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("idx") % len(WEIGHTS) + 1).cast("int")).cast("long"))
        .withColumns({"num": num, "den": den})
        .withColumn("full", w * F.col("num") >= cap * F.col("den"))
    )
    first = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / w).alias("r"), "idx", "num", "den"))).over(one)
    return level.withColumn("first", first).select(
        "source", "source_size", "idx", "w",
        F.when(F.col("full") | F.col("first").isNull(), cap.cast("double"))
        .otherwise((w * F.col("first.num")).cast("double") / F.col("first.den").cast("double"))
        .alias("target"),
    )


def shuffled(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, idx, off): each document's place in its source's shuffled stream; and the sources."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 15), 16, 10)
    rows = staged(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), number.cast("long").alias("h")),
        "mix-rows",
    )
    sources = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    own = rows.alias("r").join(sources.select("source", "idx").alias("s"), F.expr("r.source <=> s.source")).select(
        "r.doc_id", "r.size", "r.h", "s.idx", F.shiftright("h", CELL_SHIFT).alias("cell")
    )
    cells = own.groupBy("idx", "cell").agg(F.sum("size").alias("n"))
    cells = cells.select("idx", "cell", (F.sum("n").over(Window.partitionBy("idx").orderBy("cell")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("idx", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.withColumn("local", F.sum("size").over(inside) - F.col("size")).join(cells, ["idx", "cell"])
    return staged(placed.select("doc_id", "size", "idx", (F.col("base") + F.col("local")).alias("off")), "mix-places"), sources


def schedule(sources: DataFrame) -> DataFrame:
    """(idx, block, slot): every block that a source owes, and the slot at which it comes."""
    spark = sources.sparkSession
    need = sources.select("idx", F.floor(F.col("target") + 0.5).cast("long").alias("goal")).withColumn(
        "blocks", F.ceil(F.col("goal") / BLOCK).cast("long")
    )
    total = need.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    upto = Window.partitionBy(F.lit(0)).orderBy("idx")
    shares = need.where("blocks > 0").select("idx", "blocks", F.sum("blocks").over(upto).alias("hi"))
    shares = shares.select("idx", ((F.col("hi") - F.col("blocks")) / F.lit(max(total, 1))).alias("lo"), (F.col("hi") / F.lit(max(total, 1))).alias("hi"))
    # an equal join on grid cells in place of a join on ranges
    shares = shares.withColumn("grid", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))))
    point = F.pmod(F.pmod(F.floor(F.col("id") / RUN) * F.pmod(F.lit(GOLDEN * RUN), F.lit(1.0)), F.lit(1.0)) + F.col("id") % RUN * F.lit(GOLDEN), F.lit(1.0))
    slots = (
        spark.range(total).withColumn("u", point).withColumn("grid", F.floor(F.col("u") * GRID))
        .join(shares, "grid").where("u >= lo and u < hi")
        .select(F.col("id").alias("slot"), "idx", F.floor(F.col("id") / RUN).alias("run"))
    )
    runs = slots.groupBy("idx", "run").agg(F.count("*").alias("n"))
    runs = runs.select("idx", "run", (F.sum("n").over(Window.partitionBy("idx").orderBy("run")) - F.col("n")).alias("base"))
    ranked = slots.withColumn("local", F.row_number().over(Window.partitionBy("idx", "run").orderBy("slot")) - 1).join(runs, ["idx", "run"])
    ranked = ranked.select("idx", (F.col("base") + F.col("local")).alias("block"), "slot")
    counts = slots.groupBy("idx").agg(F.count("*").alias("n"))
    owed = (
        need.join(counts, "idx", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("blocks > n")
        .select("idx", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)).alias("block"))
        .withColumn("slot", F.lit(total) + F.col("block"))
    )
    return ranked.unionByName(owed.select("idx", "block", "slot"))


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix: (places, sources, takes).

    ``takes`` has a row for each piece of a document in a slot: slot, idx, doc_id, size, off, epoch,
    from_word, n_words.  A document of no words is in no slot.  Sources go by code point, null last;
    null text has no words; equal ids and repeated rows are separate documents; extra columns are
    not read; an empty table gives empty results.  The order is a hash of doc_id: reruns agree.
    """
    places, sources = shuffled(docs, id_col, text_col, source_col)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    laid = (
        places.where("size > 0").join(sources.select("idx", "source_size", goal.alias("goal")), "idx")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
        .withColumn("at", F.col("off") + F.col("epoch") * F.col("source_size"))
        .where("at < goal").withColumn("till", F.least(F.col("at") + F.col("size"), F.col("goal")))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("till") - 1) / BLOCK))))
        .withColumn("begin", F.greatest(F.col("at"), F.col("block") * BLOCK))
        .withColumn("n_words", F.least(F.col("till"), (F.col("block") + 1) * BLOCK) - F.col("begin"))
        .select("idx", "block", "doc_id", "size", "off", "epoch", (F.col("begin") - F.col("at")).alias("from_word"), "n_words")
    )
    return places, sources, laid.join(schedule(sources), ["idx", "block"])


def taken_words(docs: DataFrame, id_col="doc_id") -> DataFrame:
    """doc_id, size, idx, off and the words that the mix takes of each document."""
    places, sources, takes = mix_sources(docs, id_col)
    some = takes.groupBy("idx", "off").agg(F.sum("n_words").alias("taken"))
    # among documents that have words a place is of one only; ids may be null or equal
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    rows = places.join(some, ["idx", "off"], "left").select("doc_id", "size", "idx", "off", taken.alias("taken"))
    return rows.join(sources.select("idx", "source", "source_size", "target"), "idx")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx FROM s0),
s2 AS (SELECT *, CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1),
s3 AS (
  SELECT *, 3 * (sum(source_size) OVER ()) - 2 * coalesce(sum(2 * source_size) OVER (
              ORDER BY source_size / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         2 * sum(w) OVER (ORDER BY source_size / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
  FROM s2),
s4 AS (SELECT *, w * num >= 2 * source_size * den AS filled FROM s3),
lv AS (SELECT num, den FROM s4 WHERE NOT filled ORDER BY source_size / w, idx LIMIT 1),
s5 AS (
  SELECT source, source_size,
         CASE WHEN filled OR NOT EXISTS (SELECT 1 FROM lv) THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w * (SELECT num FROM lv) AS DOUBLE) / CAST((SELECT den FROM lv) AS DOUBLE) END AS target
  FROM s4),
p AS (
  SELECT d.doc_id, d.size, s5.source_size, s5.target, CAST(floor(s5.target + 0.5) AS BIGINT) AS goal,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS off
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - off)) + greatest(0, least(size, goal - off - source_size)) AS BIGINT) AS taken
FROM p
"""
