"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over hashed words and beginnings of words is trained from confirmed toxic texts and
unlabelled texts, on the features that tell the two sides apart best.  Its risk is ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: the negatives' risk is what is left of
the unlabelled risk once the positives in it are taken off, and a step that would push it below
zero walks back instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from volscreen.llm.common import _SPACE, WordHasher, as_bytes, fresh, mix64, staged, table, text_blocks, tidy

#: Hashed features.
BUCKETS = 1 << 20
#: Letters of the beginnings of words; one counts as frequent in a text from two words and this share of them.
HEADS, FREQUENT = (3, 4, 5, 6, 7), 1 / 128
#: Features that the model is fitted on, and parts of the buckets in which they are counted.
SELECTED, PARTS = 2048, 64
EPOCHS, RATE, DECAY, MIN_DF = 300, 0.05, 2e-4, 5
FOLDS = 5
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def _frequent(bucket: np.ndarray) -> np.ndarray:
    """The bucket that says of a word's beginning that it is frequent; no two beginnings share one."""
    return (bucket * 0x9E375 + 0x5A2F1) & (BUCKETS - 1)


def features(hasher: WordHasher, texts: list[bytes], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct buckets of each text: its words, the beginnings of them, and those that are frequent in it.

    Punctuation parts words and case is folded.  With ``wanted``, a flag for each bucket, no others are given.
    """
    texts = [t.decode(errors="replace").lower().encode().translate(_LETTERS) for t in texts]
    words, first = hasher(texts)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(hasher.table[buf] * hasher.up[: len(buf)], out=sums[1:])
    letters = np.flatnonzero((buf & 0xC0) != 0x80)
    at = np.searchsorted(letters, starts)
    letters = np.append(letters, np.full(max(HEADS), len(buf) + 1))
    useful = None if wanted is None else wanted | wanted[_frequent(np.arange(BUCKETS))]

    def keys(rows: np.ndarray, hashes: np.ndarray, flags: np.ndarray | None) -> np.ndarray:
        bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        if flags is not None:
            some = flags[bucket]
            rows, bucket = rows[some], bucket[some]
        return rows * BUCKETS + bucket

    found = [keys(owner, words, wanted)]
    for k in HEADS:
        end = letters[at + k]
        ok = end <= ends
        begin = starts[ok]
        heads, count = np.unique(keys(owner[ok], mix64((sums[end[ok]] - sums[begin]) * hasher.down[begin] + np.uint64(k << 32)), useful), return_counts=True)
        row, bucket = np.divmod(heads, BUCKETS)
        often = (count > 1) & (count >= FREQUENT * n[row])
        found += [heads, row[often] * BUCKETS + _frequent(bucket[often])]
    found = np.unique(np.concatenate(found))
    if wanted is not None:
        found = found[wanted[found % BUCKETS]]
    cut = np.searchsorted(found, np.arange(len(texts) + 1) * BUCKETS)
    buckets = (found % BUCKETS).astype(np.int32)
    return [buckets[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias, by full-batch Adam on the non-negative risk."""
    weights = np.zeros(BUCKETS)
    if not positive or not unlabelled or not 0 < prior < 1:
        return weights, -30.0 if prior <= 0 or not positive else 0.0
    rows = positive + unlabelled
    n_p, n_u = len(positive), len(unlabelled)
    df = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    kept = np.flatnonzero(df >= MIN_DF)
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    flat = column[np.concatenate(rows)]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[flat >= 0]
    flat = flat[flat >= 0]
    share = np.concatenate([np.full(n_p, prior / n_p), np.full(n_u, 1 / n_u)])
    is_p = np.arange(len(rows)) < n_p
    w, bias = np.zeros(len(kept)), np.log(prior / (1 - prior))
    mean, square = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(owner, weights=w[flat], minlength=len(rows)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        minus = np.logaddexp(0, z)  # loss as a negative; as a positive it is minus - z
        left = share[~is_p] @ minus[~is_p] - share[is_p] @ minus[is_p]
        if left >= 0:
            slope = np.where(is_p, share * (p - 1) - share * p, share * p)
        else:
            slope = np.where(is_p, share * p, -share * p)
        grad = np.append(np.bincount(flat, weights=slope[owner], minlength=len(kept)) + DECAY * w, slope.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    weights[kept] = w
    return weights, float(bias)


def _bucket_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo, hi in text_blocks(texts):
                found = [f.tobytes() for f in features(hasher, [t or b"" for t in texts[lo:hi]])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(found, pa.binary())], ["doc_id", "toxic", "f"])

    return rows.select("text", "doc_id", "toxic").mapInArrow(tidy(run), "doc_id long, toxic int, f binary")


def _selected(sample: DataFrame) -> np.ndarray:
    """The buckets, SELECTED at most, whose presence in a text says most of its side (by likelihood ratio, frequent in either direction)."""
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return np.zeros(0, np.int64)
    width = BUCKETS // PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for toxic, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic, np.frombuffer(f, np.int32)] += 1  # a text's buckets are distinct
        some = np.flatnonzero(seen.any(axis=0)).astype(np.int32)
        cut = np.searchsorted(some, np.arange(PARTS + 1) * width)
        parts = [some[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        columns = [[x.tobytes() for x in parts], *([seen[k, x].tobytes() for x in parts] for k in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "bucket", "u", "p"])

    def judged(group: pa.Table) -> pa.Table:
        bucket, u, p = (np.concatenate([np.frombuffer(x, np.int32) for x in group.column(c).to_pylist()]) for c in ("bucket", "u", "p"))
        bucket, at = np.unique(bucket, return_inverse=True)
        u, p = (np.bincount(at, weights=x, minlength=len(bucket)) for x in (u, p))
        share, other = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1)
        gain = p * np.log(share / other) + (n_p - p) * np.log((1 - share) / (1 - other))
        keep = (p + u >= MIN_DF) & (gain > 0)
        return pa.table({"bucket": bucket[keep].astype(np.int32), "gain": gain[keep]})

    counts = sample.select("toxic", "f").mapInArrow(tidy(counted), "part int, bucket binary, u binary, p binary")
    best = counts.groupBy("part").applyInArrow(judged, "bucket int, gain double").orderBy(F.desc("gain"), "bucket").limit(SELECTED)
    return np.array([r.bucket for r in best.collect()], np.int64)


def _only(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``sample`` (toxic, doc_id, h, f) with the chosen buckets alone, and the bytes of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BUCKETS, bool)
        flags[chosen] = True
        for batch in batches:
            lists = [np.frombuffer(f, np.int32) for f in batch.column(3).to_pylist()]
            lists = [x[flags[x]].tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(len, lists), pa.int64()), pa.array(lists, pa.binary())], ["toxic", "doc_id", "h", "n", "f"])

    return sample.select("toxic", "doc_id", "h", "f").mapInArrow(tidy(run), "toxic int, doc_id long, h long, n long, f binary")


def train(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", max_positive: int = 6000, max_unlabelled: int = 12000, max_bytes: int = 256 << 20
) -> tuple[np.ndarray, float]:
    """A model from labelled rows outside the held-out fold.

    The sample is bounded by the parameters: at most ``max_positive`` confirmed toxic texts, and as the
    unlabelled side at most ``max_unlabelled`` texts of labelled rows whose labels are put aside, both
    picked by a hash of doc_id; the lists of their selected features take at most ``max_bytes`` (confirmed
    ones first) on the driver.  The class prior is the share of toxic labels outside the held-out fold, over all rows.
    Null ids and labels are left out; several labels of one id count as the highest, several texts of one
    id as one of them.  Without toxic labels every score is near 0.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = staged(known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "known")
    pick = F.xxhash64("doc_id", F.lit(7))
    confirmed = known.where("toxic = 1").orderBy(pick, "doc_id").limit(max_positive)
    drawn = known.select("doc_id", F.lit(0).alias("toxic")).orderBy(pick, "doc_id").limit(max_unlabelled)
    ids = confirmed.unionByName(drawn)
    sample = _bucket_rows(rows.join(F.broadcast(ids), "doc_id")).groupBy("toxic", "doc_id").agg(F.min("f").alias("f"))  # bounded by the two limits
    sample = staged(sample.select("toxic", "doc_id", pick.alias("h"), "f"), "training")
    sample = staged(_only(sample, _selected(sample)), "training-selected")
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("toxic"), "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # bounded, as above
    fits = sample.select("toxic", "doc_id", F.sum("n").over(before).alias("sum")).where(F.col("sum") <= max_bytes)
    got = sorted((r.toxic, bytes(r.f)) for r in sample.join(fits, ["toxic", "doc_id"]).select("toxic", "f").collect())
    parts = {k: [np.frombuffer(f, np.int32) for t, f in got if t == k] for k in (0, 1)}
    return fit(parts[1], parts[0], float(prior))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """A score for every row's whole text (null: the empty text), however long.

    Gives doc_id, held_out, score, predicted; with ``keep`` all columns of ``docs`` and the score
    under that name (a column of that name is replaced).  A null id is not held out.  Repeated rows
    score alike; an empty table gives an empty one.
    """
    chosen, bias = np.flatnonzero(model[0]), model[1]
    values = model[0][chosen].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weights = WordHasher(), np.zeros(BUCKETS, np.float32)
        weights[chosen] = values
        wanted = weights != 0
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1))
            out = np.zeros(len(texts))
            for lo, hi in text_blocks(texts):
                found = features(hasher, [t or b"" for t in texts[lo:hi]], wanted)
                out[lo:hi] = [weights[f].sum(dtype=np.float64) + bias for f in found]
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], name])

    name = keep or "toxic_score"
    if keep:
        docs = docs.select([c for c in docs.columns if c.lower() != keep.lower()])
        rows = docs.withColumn(*fresh(docs.columns, "scored_text"), F.col(text_col).cast("string"))
        fields = docs.schema.fields
    else:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("scored_text"))
        fields = rows.schema.fields[:1]
    scored = rows.mapInArrow(tidy(run), StructType(list(fields)).add(name, "double"))
    if keep:
        return scored
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
