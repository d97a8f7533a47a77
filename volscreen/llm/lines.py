"""Line dedup: repeated windows of three consecutive lines.

A window is three consecutive lines of one text.  Its first occurrence, by (doc_id, text hash,
position), stays; later ones are removed, which removes every line they cover.  Occurrences are
settled inside each block of rows first, so one very common window sends one row a block to the
shuffle, never one an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volscreen.llm.common import fresh, staged, table, tidy

WINDOW = 3


def _windows(rows: DataFrame) -> DataFrame:
    """(w, doc, th, pos, later): windows of each row; ``later`` ones have an earlier like in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple[int, int, int]] = {}
            later: list[tuple[int, int, int]] = []
            for doc, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = [hashlib.md5(x).digest() for x in text.encode().split(b"\n")]
                for pos in range(len(lines) - WINDOW + 1):
                    w = hashlib.md5(b"".join(lines[pos : pos + WINDOW])).digest()
                    own = (doc, th, pos)
                    seen = first.setdefault(w, own)
                    if own < seen:
                        first[w] = own
                        later.append(seen)
                    elif own > seen:
                        later.append(own)
            keys = [*first, *[None] * len(later)]
            places = [*first.values(), *later]
            cols = list(zip(*places, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())],
                ["w", "doc", "th", "pos"],
            )

    return rows.mapInArrow(tidy(run), "w binary, doc long, th long, pos int")


#: Columns that dedup_lines adds.
OUT = ("n_lines", "n_lines_removed", "line_kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, str, str] = OUT) -> DataFrame:
    """``docs`` with n_lines, n_lines_removed and line_kept (or the names ``out``), the text that stays (null stays null).

    Lines end at a line feed; an empty text is one empty line.  A null id comes after all others;
    rows of equal id and text are one document and are cut alike; texts of fewer than three lines
    are never cut.  Work on a text is linear in its length, however long.  Other columns pass through;
    columns named like ``out`` are replaced, no other name is used.  An empty table gives an empty one.
    """
    columns = [c for c in docs.columns if c.lower() not in {o.lower() for o in out}]
    text, doc, th, starts, d, h = fresh([*docs.columns, *out], "text_", "doc_", "th_", "starts_", "d_", "h_")
    id_key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.withColumns({text: F.col(text_col).cast("string"), doc: id_key}).withColumn(th, F.xxhash64(text))
    several = keyed.where(F.contains(F.col(text), F.lit("\n"))).select(F.col(doc).alias("doc"), F.col(th).alias("th"), F.col(text).alias("text"))
    found = staged(_windows(several), "line-windows")
    place = F.struct("doc", "th", "pos")
    judged = found.where("w IS NOT NULL").withColumn("best", F.min(place).over(Window.partitionBy("w")))
    gone = judged.where(place > F.col("best")).select("doc", "th", "pos").unionByName(found.where("w IS NULL").select("doc", "th", "pos"))
    places = gone.groupBy("doc", "th").agg(F.collect_set("pos").alias(starts)).withColumnsRenamed({"doc": d, "th": h})
    # only the rows that lose lines meet their positions; the join is on the row's own key
    joined = keyed.join(places, (F.col(doc) == F.col(d)) & (F.col(th) == F.col(h)), "left")
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (WINDOW - 1)))))
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *columns,
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(out[0]),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias(out[1]),
        F.when(F.col(starts).isNull(), F.col(text)).otherwise(kept).alias(out[2]),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.col("n_lines_removed").alias("n_removed"),
        F.sha2(F.coalesce("line_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, pos) > 1 AS again
  FROM w WHERE l2 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, pos + i AS pos FROM f, (SELECT unnest([0, 1, 2]) AS i) WHERE again),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS kept
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
