"""Vector search: multiprobe p-stable hashing, and exact top-k by columnar branch-and-bound.

A stated query set meets all rows in blocks of queries, one job each: the driver holds one block at
a time and no plan grows with the queries.  A block travels to the workers in the task's closure:
BLOCK * dimensions * 16 bytes at most for exact search, PROBED * (TABLES * PROBES + dimensions) * 8
(52 MB and the vectors) for hashing.  The rows are not shuffled.  Each task keeps k rows a query, and
only those are merged by query and written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volscreen.llm.common import staged, staged_path, stored, table, tidy

#: Queries in a block (of exact search, of hashing) and rows that a task looks at together.
BLOCK, PROBED, ROWS = 4096, 1024, 16384
#: Hash tables, hashes in each, bucket width on unit vectors and buckets visited per table.
TABLES, HASHES, WIDTH, PROBES = 16, 6, 1.0, 400
SEED = 20240917


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (doubles): rows whose id is not null and whose vector is neither null nor empty, nor holds null or non-finite."""
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Blocks of at most ``most`` queries; one partition at a time comes to the driver."""
    ids, vecs = [], []
    for r in queries.toLocalIterator():
        ids.append(r.vec_id)
        vecs.append(np.array(r.v))
        if len(ids) == most:
            yield np.array(ids), vecs
            ids, vecs = [], []
    if ids:
        yield np.array(ids), vecs


def by_size(ids: np.ndarray, vecs: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors as matrices, one for each number of dimensions."""
    size = np.array([len(v) for v in vecs])
    return {int(n): (ids[size == n], np.stack([vecs[i] for i in np.flatnonzero(size == n)])) for n in np.unique(size)}


def matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows of a task, ROWS at a time, as matrices."""
    kept: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(parts)
        ids = t.column(0).to_numpy()
        col = t.column(1).combine_chunks()
        flat, at = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
        sizes = np.diff(at)
        if len(sizes) and (sizes == sizes[0]).all():
            return {int(sizes[0]): (ids, flat.reshape(len(ids), -1))}
        return by_size(ids, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(b.num_rows for b in kept) >= ROWS:
            yield out(kept)
            kept = []
    if kept:
        yield out(kept)


class Best:
    """The k best (score, then smaller id) of every query of a matrix."""

    def __init__(self, n: int, k: int, kind: type):
        self.k, self.scores, self.ids = k, [np.zeros(0, kind)] * n, [np.zeros(0, np.int64)] * n

    def floor(self, q: int):
        """Only rows of at least this score can enter."""
        return self.scores[q][-1] if len(self.scores[q]) == self.k else None

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def _search(rows: DataFrame, query_mod: int, k: int, kind: str, visit: Callable, prepare: Callable, most: int) -> DataFrame:
    spark = rows.sparkSession
    kept = staged(rows, "vectors")
    picked = kept.where(F.col("vec_id") % query_mod == 0).dropDuplicates()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = f"query_id long, rank int, vec_id long, score {kind}"
    paths = []
    for ids, vecs in query_blocks(picked, most):
        groups = {n: (i, *prepare(m)) for n, (i, m) in by_size(ids, vecs).items()}

        def run(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            best = {n: Best(len(g[0]), k, np.float64 if kind == "double" else np.int64) for n, g in groups.items()}
            for mats in matrix_rows(batches):
                for n, (rid, m) in mats.items():
                    if n in groups:
                        visit(groups[n], rid, m, best[n])
            for n, b in best.items():
                for q, qid in enumerate(groups[n][0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(b.ids[q]), qid)), pa.array(b.ids[q]), pa.array(b.scores[q])],
                        ["query_id", "vec_id", "score"],
                    )

        found = kept.mapInArrow(tidy(run), f"query_id long, vec_id long, score {kind}")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        paths.append(staged_path(spark, "nearest"))
        stored(found.select("query_id", "rank", "vec_id", "score"), paths[-1])
    if not paths:
        return spark.createDataFrame([], out)
    nearest = spark.read.schema(out).parquet(*paths)
    if len(paths) == 1:
        return nearest
    # rows of one id may be queries of two blocks
    return nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- multiprobe p-stable hashing ----------------------------------------------------------


def planes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian (2-stable) directions and offsets of all tables, for n dimensions."""
    rng = np.random.default_rng((SEED, n))
    return rng.standard_normal((n, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def probe_sets(n: int = HASHES, count: int = PROBES) -> list[list[int]]:
    """Perturbation sets over the 2n steps sorted by cost, in order of their expected cost.

    Step j and step 2n-1-j move the same hash in opposite ways, so no set holds both.  Expected squared
    distances of the sorted steps are those of uniform order statistics.
    """
    import heapq

    j = np.arange(1, n + 1)
    cost = np.concatenate([j * (j + 1) / (4 * (n + 1) * (n + 2)), 1 - (j[::-1] / (n + 1)) + j[::-1] * (j[::-1] + 1) / (4 * (n + 1) * (n + 2))])
    heap, sets = [(cost[0], (0,))], [[]]
    while heap and len(sets) < count:
        c, s = heapq.heappop(heap)
        if all(2 * n - 1 - x not in s for x in s):
            sets.append(list(s))
        last = s[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    return sets


def codes(cells: np.ndarray) -> np.ndarray:
    """One 64-bit code for each (row, table) of cells[row, table, hash]."""
    mult = np.random.default_rng(SEED).integers(1, 1 << 62, HASHES, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (cells * mult).sum(axis=2)


def probes(unit: np.ndarray) -> np.ndarray:
    """Bucket codes [query, table, probe] in estimated order of success."""
    a, b = planes(unit.shape[1])
    place = ((unit @ a + b) / WIDTH).reshape(len(unit), TABLES, HASHES)
    cell = np.floor(place).astype(np.int64)
    low = place - cell
    steps = np.concatenate([low, 1 - low], axis=2)  # distance to the lower and the upper neighbour
    order = np.argsort(steps, axis=2, kind="stable")
    out = []
    for s in probe_sets():
        moved = cell.copy()
        for x in s:
            step = order[:, :, x : x + 1]
            np.put_along_axis(moved, step % HASHES, np.take_along_axis(moved, step % HASHES, 2) + np.where(step < HASHES, -1, 1), 2)
        out.append(codes(moved))
    return np.stack(out, axis=2)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(scale > 0, scale, 1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1), scale[:, 0] > 0


def _visit_buckets(group: tuple, rid: np.ndarray, m: np.ndarray, best: Best) -> None:
    qid, q_unit, q_probe, q_ok = group
    unit, ok = _unit(m)
    rid, unit = rid[ok], unit[ok]
    if not len(rid):
        return
    # equal vectors stand in one place of the index: k smallest other ids of each are all that can be asked for
    order = np.lexsort((rid, *unit.T[:4]))
    same = np.concatenate([[False], (unit[order][1:] == unit[order][:-1]).all(axis=1)])
    starts = np.flatnonzero(~same)
    rid = rid[order]
    members, place = np.split(rid, starts[1:]), np.cumsum(~same) - 1
    unit = unit[order][starts]
    a, b = planes(unit.shape[1])
    code = codes(np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, HASHES))
    by_table = [np.argsort(code[:, t], kind="stable") for t in range(TABLES)]
    sorted_codes = [code[by_table[t], t] for t in range(TABLES)]
    edges = [(np.searchsorted(sorted_codes[t], q_probe[:, t], "left"), np.searchsorted(sorted_codes[t], q_probe[:, t], "right")) for t in range(TABLES)]
    for q in np.flatnonzero(q_ok):
        hit = np.zeros(len(unit), bool)
        for t in range(TABLES):
            lo, hi = edges[t][0][q], edges[t][1][q]
            for i in np.flatnonzero(hi > lo):
                hit[by_table[t][lo[i] : hi[i]]] = True
        # a place that only rows of the query's id share offers nothing
        mine, count = np.unique(place[rid == qid[q]], return_counts=True)
        hit[[p for p, c in zip(mine, count, strict=True) if c == len(members[p])]] = False
        found = np.flatnonzero(hit)
        if not len(found):
            continue
        near = (unit[found] * q_unit[q]).sum(axis=1)
        if len(found) > best.k:
            enough = np.argpartition(-near, best.k - 1)[: best.k]
            least = near[enough].min()
            at = np.flatnonzero(near >= least)
            found, near = found[at], near[at]
        held = {*mine.tolist()}
        ids = [(members[f][members[f] != qid[q]] if f in held else members[f])[: best.k] for f in found.tolist()]
        best.add(q, np.repeat(near, [len(i) for i in ids]), np.concatenate(ids))


def _prepare_probes(m: np.ndarray) -> tuple:
    unit, ok = _unit(m)
    return unit, probes(unit), ok


def approximate_neighbours(rows: DataFrame, k: int = 5, query_mod: int = 50, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine that multiprobe hashing finds.

    Queries are the rows whose id is divisible by ``query_mod``; a row is no candidate of a query of
    its own id, nor of one of other dimensions.  Every row is indexed.  Null ids, null, empty and
    zero vectors and those holding null or non-finite components take no part.  Ties go to the
    smaller id; other columns are not read; an empty table gives an empty one.
    """
    return _search(vectors(rows, id_col, vec_col), query_mod, k, "double", _visit_buckets, _prepare_probes, PROBED)


# --- exact top-k --------------------------------------------------------------------------

DIMENSIONS = 16
#: Below this every sum of products of whole numbers is exact in doubles.
WHOLE = 2.0**53


def _prepare_exact(m: np.ndarray) -> tuple:
    with np.errstate(over="ignore"):
        rest = [np.sqrt((m[:, d:].astype(np.float64) ** 2).sum(axis=1)) for d in range(0, m.shape[1] + DIMENSIONS, DIMENSIONS)]
    return m, np.stack(rest)


def _large_products(query: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products in integers of any size, held at the ends of a long."""
    q = [int(x) for x in query]
    sums = [sum(a * int(x) for a, x in zip(q, row, strict=True)) for row in m]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)


def _branch_and_bound(group: tuple, rid: np.ndarray, m: np.ndarray, best: Best) -> None:
    """Add up products block by block of dimensions, dropping rows that the mass still to come cannot save.

    Rows whose product with the query may not be exact in doubles are multiplied as integers instead.
    """
    qid, queries, q_rest = group
    columns = np.ascontiguousarray(m.T)  # vertical layout
    rest = _prepare_exact(m)[1]
    for q in range(len(queries)):
        own = rid == qid[q]  # rows of the query's id are no candidates, nor may they bound others
        with np.errstate(invalid="ignore", over="ignore"):
            small = rest[0] * q_rest[0, q] * (1 + 1e-9) < WHOLE
        if not small.all():
            large = np.flatnonzero(~small & ~own)
            best.add(q, _large_products(queries[q], m[large]), rid[large])
        alive = np.flatnonzero(small & ~own) if own.any() or not small.all() else None
        score = np.zeros(len(rid) if alive is None else len(alive))
        for j, d in enumerate(range(0, len(columns), DIMENSIONS)):
            part = columns[d : d + DIMENSIONS] if alive is None else columns[d : d + DIMENSIONS, alive]
            score = score + queries[q, d : d + DIMENSIONS] @ part
            left = q_rest[j + 1, q] * (rest[j + 1] if alive is None else rest[j + 1][alive]) * (1 + 1e-9)
            least = best.floor(q)
            if len(score) > best.k:
                sure = np.partition(score - left, len(score) - best.k)[len(score) - best.k]
                least = sure if least is None else max(least, sure)
            if least is None:
                continue
            keep = np.flatnonzero(score + left + 0.5 >= least)
            if len(keep) < 0.7 * len(score):
                alive = keep if alive is None else alive[keep]
                score = score[keep]
        best.add(q, np.rint(score).astype(np.int64), rid if alive is None else rid[alive])


def exact_top_k(rows: DataFrame, k: int = 10, query_mod: int = 100, scale: int = 1024, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x).

    Exact at any size; a product beyond a long is held at its end.  Queries are the rows whose id is divisible by
    ``query_mod``; a row is no candidate of a query of its own id, nor of one of other dimensions.
    Null ids, null and empty vectors and those holding null or non-finite components take no part.
    Ties go to the smaller id; other columns are not read; an empty table gives an empty one.
    """
    rows = vectors(rows, id_col, vec_col)
    most = F.lit(float(np.finfo(np.float64).max))

    def scaled(x):
        y = F.greatest(-most, F.least(most, x * float(scale)))
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)  # doubles from 2**53 on are whole

    whole = rows.select("vec_id", F.transform("v", scaled).alias("v"))
    return _search(whole, query_mod, k, "long", _branch_and_bound, _prepare_exact, BLOCK)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
