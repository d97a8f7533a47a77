"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words.  Its fingerprint is the least hash of the GRAM-word sequences
in it, so equal windows have equal fingerprints and a text has few.  The index lies in a folder: the
texts of each batch in buckets of their document, and sorted immutable runs of (fingerprint, document)
in buckets of the fingerprint.  A new batch's run is merge-joined with the runs of history; the windows
under fingerprints that several documents share are verified by two 64-bit hashes of all their words,
each with multipliers and word hashes of its own.  Too many runs are compacted into one and deleted.  A
later session opens the folder and goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volscreen.llm.common import (
    WordHasher, as_bytes, bucketed, discard, finished, gram_hashes, partitions, reopened, staged, staged_path, table, text_blocks, tidy,
)  # fmt: skip

WINDOW, GRAM = 13, 5
BATCHES, MOST_RUNS = 3, 2
_RUN, _TEXTS = "fp BIGINT, doc BIGINT", "doc BIGINT, th BIGINT, copy BOOLEAN, text STRING"


def fingerprints(words: np.ndarray) -> np.ndarray:
    """The fingerprint of every window of a block of words."""
    grams = gram_hashes(words, GRAM)
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64)
    low = grams[: len(grams) - span + 1].copy()
    for j in range(1, span):
        np.minimum(low, grams[j : j + len(low)], out=low)
    return low


def _fingerprint_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            for lo, hi in text_blocks(texts):
                words, first = hasher(texts[lo:hi])
                low = fingerprints(words)
                own = [np.unique(low[a : max(a, b - WINDOW + 1)]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(docs[lo:hi], [len(x) for x in own]))], ["fp", "doc"]
                )

    return rows.select("doc", "text").mapInArrow(tidy(run), "fp long, doc long")


class FingerprintIndex:
    """The index under ``root``; folders that an interrupted step left are not read.

    ``run-<first batch>-<last batch>-<buckets>`` are the runs, ``texts-<batch>-<buckets>`` the texts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.runs: list[tuple[int, int, str, DataFrame]] = []
        self.texts: list[tuple[str, DataFrame]] = []
        spans = []
        for name in finished(spark, self.root):
            if m := re.fullmatch(r"texts-(\d+)-(\d+)", name):
                self.texts.append((name, reopened(spark, f"{self.root}/{name}", _TEXTS, "doc", int(m[2]))))
            elif m := re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", name):
                spans.append((int(m[1]), int(m[2]), int(m[3]), name))
        for lo, hi, n, name in sorted(spans):
            if not any(a <= lo and hi <= b and (a, b) != (lo, hi) for a, b, *_ in spans):  # else compacted
                self.runs.append((lo, hi, name, reopened(spark, f"{self.root}/{name}", _RUN, "fp", n)))
        # texts without a run are of a batch that never ended
        self.texts = self.texts[: self.runs[-1][1] + 1 if self.runs else 0]

    def _write(self, rows: DataFrame, lo: int, hi: int) -> None:
        n = partitions(self.spark)
        name = f"run-{lo:06d}-{hi:06d}-{n}"
        discard(self.spark, f"{self.root}/{name}")
        self.runs.append((lo, hi, name, bucketed(rows, "fp", f"{self.root}/{name}", n)))

    def _compact(self) -> None:
        if len(self.runs) >= MOST_RUNS:
            old, self.runs = self.runs, []
            self._write(reduce(DataFrame.unionByName, (r for *_, r in old)), old[0][0], old[-1][1])
            for *_, name, _r in old:
                discard(self.spark, f"{self.root}/{name}")

    def append(self, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Take in (fp, doc) rows; returns the fingerprints they share, with each other or with history, and the runs of history."""
        self._compact()
        past, batch = [r for *_, r in self.runs], self.runs[-1][1] + 1 if self.runs else 0
        self._write(rows, batch, batch)
        new = self.runs[-1][3]
        seen = new.groupBy("fp").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        shared = seen.where("lo < hi").select("fp")
        for old in past:
            shared = shared.unionByName(seen.select("fp").join(old.select("fp"), "fp", "left_semi"))
        return bucketed(shared.distinct(), "fp", staged_path(self.spark, "shared")), past

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in (doc, text) rows and judge them: doc, n_words, n_removed, kept of each.

        A word goes if a window over it also starts in a document of smaller id, of this batch or of history.
        Batches added in rising order of ids give what one batch of them all gives.
        """
        spark, n = self.spark, partitions(self.spark)
        keyed = batch.select("doc", F.sha2("text", 256).alias("sha"), "text")
        keyed = keyed.withColumn("th", F.coalesce(F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"), F.lit(0)))
        # documents that hold the whole text of a smaller one need no windows of their own
        same = Window.partitionBy("sha")
        copies = keyed.where("sha IS NOT NULL").select("doc", "th", "sha").withColumn("least", F.min("doc").over(same)).where("doc > least")
        copies = staged(copies.groupBy("doc").agg(F.collect_set("th").alias("ths")), "copies")
        name = f"texts-{self.runs[-1][1] + 1 if self.runs else 0:06d}-{n}"
        discard(spark, f"{self.root}/{name}")
        marked = keyed.join(copies, "doc", "left").select("doc", "th", F.coalesce(F.array_contains("ths", F.col("th")), F.lit(False)).alias("copy"), "text")
        texts = bucketed(marked, "doc", f"{self.root}/{name}", n)
        shared, past = self.append(_fingerprint_rows(texts.where("NOT copy AND text IS NOT NULL")))
        known = reduce(DataFrame.unionByName, (t for _, t in self.texts)) if self.texts else None
        self.texts.append((name, texts))
        suspects = self._suspects(texts, [self.runs[-1][3]], shared, True)
        if known is not None:
            suspects = suspects.unionByName(self._suspects(known, past, shared, False))
        found = _windows(suspects).withColumn("best", F.min("doc").over(Window.partitionBy("h1", "h2")))
        gone = found.where("new AND (later OR doc > best)").select("doc", F.struct("th", "pos", "len").alias("gone"))
        starts = staged(gone.groupBy("doc").agg(F.collect_list("gone").alias("gone")), "starts")
        return _cut(texts.join(starts, "doc", "left"))

    def _suspects(self, texts: DataFrame, runs: list[DataFrame], shared: DataFrame, new: bool) -> DataFrame:
        holders = reduce(DataFrame.unionByName, (r.join(shared, "fp", "left_semi") for r in runs)).groupBy("doc").agg(F.collect_set("fp").alias("fps"))
        return texts.where("NOT copy AND text IS NOT NULL").join(holders, "doc").select("doc", "th", "text", "fps", F.lit(new).alias("new"))


def _windows(rows: DataFrame) -> DataFrame:
    """(h1, h2, doc, th, pos, len, later, new) of the windows under the fingerprints ``fps`` of each row.

    ``later`` rows stand for len windows on end that have a like in a smaller document of their block
    (doc and pos are in the place of their hashes); of windows of history one stands for each hash pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = WordHasher(), WordHasher(salt=1)
        for batch in batches:
            docs, ths, texts, fps, new = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_bytes(batch.column(2)), batch.column(3), np.array(batch.column(4).to_pylist(), bool)
            for lo, hi in text_blocks(texts, 1 << 23):
                at, owner, h1, h2 = [], [], [], []
                for x, y in text_blocks(texts[lo:hi]):
                    words, first = hasher(texts[lo + x : lo + y])
                    low, one, two = fingerprints(words), gram_hashes(words, WINDOW), gram_hashes(other(texts[lo + x : lo + y])[0], WINDOW, 1)
                    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                        if b - a >= WINDOW:
                            hit = a + np.flatnonzero(np.isin(low[a : b - WINDOW + 1], fps[lo + x + i].values.to_numpy().view(np.uint64)))
                            at.append(hit - a)
                            owner.append(np.full(len(hit), x + i))
                            h1.append(one[hit])
                            h2.append(two[hit])
                if not at:
                    continue
                at, owner, h1, h2 = map(np.concatenate, (at, owner, h1, h2))
                doc = docs[lo:hi][owner]
                order = np.lexsort((at, doc, h2, h1))
                at, owner, h1, h2, doc = (v[order] for v in (at, owner, h1, h2, doc))
                fresh = np.ones(len(at), bool)
                fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(at) else doc
                mine = new[lo:hi][owner]
                late = np.flatnonzero((doc > least) & mine)
                late = late[np.lexsort((at[late], owner[late]))]
                cut = np.ones(len(late), bool)
                cut[1:] = (owner[late][1:] != owner[late][:-1]) | (at[late][1:] != at[late][:-1] + 1)
                begin = np.flatnonzero(cut)
                spans = np.diff(np.append(begin, len(late)))
                head, open_ = late[begin], np.flatnonzero((doc == least) & (mine | fresh))
                rows = np.concatenate([head, open_])
                k = len(head)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([doc[head], h1[open_].view(np.int64)])), pa.array(np.concatenate([at[head], h2[open_].view(np.int64)])),
                        pa.array(doc[rows]), pa.array(ths[lo:hi][owner[rows]]), pa.array(at[rows].astype(np.int32)),
                        pa.array(np.concatenate([spans, np.ones(len(open_), int)]).astype(np.int32)),
                        pa.array(np.arange(len(rows)) < k), pa.array(mine[rows]),
                    ],
                    ["h1", "h2", "doc", "th", "pos", "len", "later", "new"],
                )  # fmt: skip

    return rows.mapInArrow(tidy(run), "h1 long, h2 long, doc long, th long, pos int, len int, later boolean, new boolean")


def _cut(rows: DataFrame) -> DataFrame:
    """doc, n_words, n_removed, kept of rows (doc, th, text, copy, gone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ths, texts, copies, gone = batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4)
            total, lost, kept = [], [], []
            for i, t in enumerate(texts):
                # white space of the contract; bytes.split() parts at exactly these six
                words = (t or b"").split()
                covered = None
                if copies[i] and len(words) >= WINDOW:
                    covered = np.ones(len(words), bool)
                elif gone[i].is_valid:
                    th, pos, span = (gone[i].values.field(c).to_numpy() for c in range(3))
                    pos, span = pos[th == ths[i]], span[th == ths[i]]
                    drop = np.zeros(len(words) + 1, np.int32)
                    np.add.at(drop, pos, 1)
                    np.add.at(drop, pos + span + WINDOW - 1, -1)
                    covered = np.cumsum(drop)[:-1] > 0
                total.append(len(words))
                lost.append(0 if covered is None else int(covered.sum()))
                kept.append(b" ".join(words if covered is None else [w for w, c in zip(words, covered.tolist(), strict=True) if not c]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc", "n_words", "n_removed", "kept"],
            )

    return rows.select("doc", "th", "text", "copy", "gone").mapInArrow(tidy(run), "doc long, n_words long, n_removed long, kept string")


#: The id of rows without one: larger than all others.
NO_ID = (1 << 63) - 1


def dedup_substrings(docs: DataFrame, id_col="doc_id", text_col="text", index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row; kept words are joined by one space.

    The rows enter ``index`` (a new one, if none is given) in BATCHES batches of rising ids and are
    judged against each other and what the index holds already.  A null text has no words.  A null id
    is larger than all others, so its document loses what any other shares with it.  Rows of one id are
    one document for the rule: they take nothing from each other.  Very long texts are hashed alone, in
    memory that grows with the text.  Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark, staged_path(spark, "index"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    cuts = rows.approxQuantile("doc", [i / BATCHES for i in range(1, BATCHES)], 0.01)
    edges, out = [None, *sorted({int(c) for c in cuts}), None], None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = rows
        if lo is not None:
            part = part.where(F.col("doc") >= lo)
        if hi is not None:
            part = part.where(F.col("doc") < hi)
        judged = index.add(part)
        out = judged if out is None else out.unionByName(judged)
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
n AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d),
k AS (SELECT doc_id, unnest(range(1, n - {WINDOW - 2})) AS p, w FROM n WHERE n >= {WINDOW}),
h AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g FROM k),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) < doc_id AS later FROM h),
c AS (SELECT DISTINCT doc_id, p + i AS q FROM f, (SELECT unnest(range({WINDOW})) AS i) WHERE later),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS q FROM n),
r AS (
  SELECT t.doc_id, count(c.q) AS n_removed, string_agg(t.word, ' ' ORDER BY t.q) FILTER (WHERE c.q IS NULL) AS kept
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.q = c.q GROUP BY t.doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM n LEFT JOIN r ON n.doc_id = r.doc_id
"""
