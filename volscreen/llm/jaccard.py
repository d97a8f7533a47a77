"""N-gram Jaccard join with prefix filters under several global token orders.

Texts of equal shingle sets are one representative.  Two sets of at least 75 % similarity share a
token in the prefixes of both under every global order.  The first order (common tokens last) gives
the candidates by an equal join on prefix tokens, one row for each run of common tokens; the other
orders travel as a sketch of each set and are intersected before any text is fetched; what passes
them all is verified on whole texts.  A pass over one candidate a set settles large groups of near
copies first, so the full pass joins only sets that are not yet in one component: the components are
complete, but links inside a component are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volscreen.llm.common import WordHasher, as_bytes, bucketed, discard, gram_hashes, mix64, partitions, small_batches, staged, staged_path, stored, table, text_blocks, tidy

WORDS, NUM, DEN = 5, 75, 100
#: Hash orders besides the first, and hash classes of tokens (each stands for an order that puts it first).
ORDERS, CLASSES = 2, 128
#: Tokens that stand last in the first order: the most common ones, at most so many (16 bytes each).
COMMON = 1 << 19
#: Tokens counted in one group, and bytes of texts whose tokens are counted together before.
BUCKET, BLOCK = 1 << 22, 1 << 22
#: Further passes of one candidate a set, over groups of at least LARGE sets.
CENTRES, LARGE = 1, 16


def shingle_sets(hasher: WordHasher, texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = hasher(texts)
    grams = gram_hashes(words, WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a, 1) if b > a else np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def count_keys(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (rising with the token) and 32 further bits, under which tokens are counted."""
    bucket = ((tokens >> np.uint64(44)) * np.uint64(buckets)) >> np.uint64(20)
    return bucket, (tokens >> np.uint64(12)).astype(np.uint32)


def prefix(tokens: np.ndarray, order: int, common: np.ndarray, rank: np.ndarray, buckets: int = 1) -> np.ndarray:
    """The first tokens of a set under a global order (0: ``common`` count keys last, by rising count)."""
    key = mix64(tokens ^ np.uint64((order + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    if order == 0 and len(common):
        bucket, bits = count_keys(tokens, buckets)
        mine = bucket << np.uint64(32) | bits
        at = np.minimum(np.searchsorted(common, mine), len(common) - 1)
        last = common[at] == mine
        key = np.where(last, np.uint64(1 << 63) + rank[at], key >> np.uint64(1))
    return tokens[np.argsort(key, kind="stable")[: prefix_size(len(tokens))]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def sketch(tokens: np.ndarray) -> bytes:
    """What the further orders say of a set: 32 bits of each prefix token under the ORDERS hash orders, then the
    sizes of the CLASSES hash classes (under the order that puts a class first, its tokens come first)."""
    none = np.zeros(0, np.uint64)
    parts = [np.unique(prefix(tokens, o, none, none).astype(np.uint32)) for o in range(1, ORDERS + 1)]
    sizes = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES).astype(np.uint32)
    return np.concatenate([np.array([len(tokens), *map(len, parts)], np.uint32), sizes, *parts]).tobytes()


def may_be_similar(a: bytes, b: bytes) -> bool:
    """False only if some order shows that the sets cannot be similar.

    They share a prefix token under every hash order, and under the order of a class no more of its
    tokens than the smaller of their two classes.
    """
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    body = 1 + ORDERS
    if (NUM + DEN) * int(np.minimum(x[body : body + CLASSES], y[body : body + CLASSES]).sum()) < NUM * (int(x[0]) + int(y[0])):
        return False
    i = j = body + CLASSES
    for o in range(1, ORDERS + 1):
        m, n = int(x[o]), int(y[o])
        if not len(np.intersect1d(x[i : i + m], y[j : j + n], assume_unique=True)):
            return False
        i, j = i + m, j + n
    return True


def _sets(rows: DataFrame) -> DataFrame:
    """row, hash of the text, n, sig for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        hasher = WordHasher(lower=True)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in text_blocks(texts):
                sets = shingle_sets(hasher, [t or b"" for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in (0, 2)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                    ],
                    ["doc", "th", "n", "sig"],
                )

    return rows.mapInArrow(tidy(run), "doc long, th binary, n long, sig binary")


def _tokens_and_sketches(texts: DataFrame, buckets: int) -> DataFrame:
    """(doc, sk) for every text; (bucket, once, often, counts) for the tokens of every block of texts.

    Tokens travel as packed arrays of their 32 bits: those that the block holds once, then those that
    it holds more often, with counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            docs, texts = batch.column(0), as_bytes(batch.column(1))
            for lo, hi in text_blocks(texts, BLOCK):
                some = texts[lo:hi]  # counted together, hashed a small block at a time
                sets = [s for x, y in text_blocks(some) for s in shingle_sets(hasher, some[x:y])]
                tok, count = np.unique(np.concatenate(sets), return_counts=True)
                bucket, bits = count_keys(tok, buckets)
                cut = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63), append=np.uint64(1 << 63)))
                packed = []
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    one = count[x:y] == 1
                    packed.append((int(bucket[x]), bits[x:y][one].tobytes(), bits[x:y][~one].tobytes(), count[x:y][~one].astype(np.uint32).tobytes()))
                k, n = len(packed), hi - lo
                columns = list(zip(*packed, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([docs.slice(lo, n), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([pa.array([sketch(s) for s in sets], pa.binary()), pa.nulls(k, pa.binary())]),
                        *(pa.concat_arrays([pa.nulls(n, t), pa.array(c, t)]) for t, c in zip((pa.int64(), *[pa.binary()] * 3), columns, strict=True)),
                    ],
                    ["doc", "sk", "bucket", "once", "often", "counts"],
                )

    return texts.select("doc", "text").mapInArrow(tidy(run), "doc long, sk binary, bucket long, once binary, often binary, counts binary")


def _common(packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and ranks of the COMMON most common tokens, by their counts over all texts.

    A bucket holds about BUCKET tokens, so that its group fits a task.  Any choice gives right results.
    """

    def run(group: pa.Table) -> pa.Table:
        arrays = [np.concatenate([np.frombuffer(x, np.uint32) for x in group.column(c).to_pylist()]) for c in ("once", "often", "counts")]
        bits, at = np.unique(np.concatenate(arrays[:2]), return_inverse=True)
        count = np.bincount(at[: len(arrays[0])], minlength=len(bits)) + np.bincount(at[len(arrays[0]) :], weights=arrays[2], minlength=len(bits)).astype(np.int64)
        keep = count >= 3
        key = bits[keep].astype(np.int64) | group.column("bucket")[0].as_py() << 32
        return pa.table({"key": key, "c": count[keep]})

    counts = packed.groupBy("bucket").applyInArrow(run, "key long, c long")
    best = staged(counts.orderBy(F.desc("c"), "key").limit(COMMON), "common").toArrow()  # at most COMMON rows
    key, count = best.column("key").to_numpy(), best.column("c").to_numpy()
    falling = np.lexsort((key, -count))
    key, order = key[falling].view(np.uint64), np.argsort(key[falling].view(np.uint64))
    return key[order], np.arange(len(key), 0, -1).astype(np.uint64)[order]


def _prefixes(texts: DataFrame, common: np.ndarray, rank: np.ndarray, buckets: int) -> DataFrame:
    """tok, doc, n, pos, prev: every prefix token under the first order, its place and the token before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            for lo, hi in text_blocks(texts):
                sets = shingle_sets(hasher, texts[lo:hi])
                firsts = [prefix(s, 0, common, rank, buckets) for s in sets]
                k = [len(f) for f in firsts]
                tok, pos = np.concatenate(firsts).view(np.int64), np.concatenate([np.arange(x) for x in k]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tok), pa.array(np.repeat(docs[lo:hi], k)), pa.array(np.repeat([len(s) for s in sets], k).astype(np.int32)),
                        pa.array(pos), pa.array(np.roll(tok, 1), mask=pos == 0),
                    ],
                    ["tok", "doc", "n", "pos", "prev"],
                )

    return texts.select("doc", "text").mapInArrow(tidy(run), "tok long, doc long, n int, pos int, prev long")


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """a, b, x, y: the ``column`` of both; ``table`` lies in buckets of doc and is not shuffled."""
    left = pairs.join(table.select(F.col("doc").alias("a"), F.col(column).alias("x")), "a")
    return left.join(table.select(F.col("doc").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")


def _verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar: all orders are intersected first, texts are fetched for what is left."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_be_similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            left, right = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi in text_blocks(right):
                x, y = shingle_sets(hasher, left[lo:hi]), shingle_sets(hasher, right[lo:hi])
                ok[lo:hi] = [similar(p, q) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = staged(_both(pairs, sketches, "sk").mapInArrow(tidy(filtered), "a long, b long"), "candidates")
    return _both(left, texts, "text").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) of every linked node: comp is the smallest node reachable.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing moves.
    """
    spark, sizes, held = links.sparkSession, [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")], []

    def kept(rows: DataFrame) -> tuple:
        held.append(staged_path(spark, "edges"))
        edges = stored(rows, held[-1])
        for path in held[:-1]:
            discard(spark, path)
        del held[:-1]
        return edges, edges.agg(*sizes).first()

    edges, state = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(small_low.select("u", F.col("m").alias("v"))).distinct()
        )
        before = state
        edges, state = kept(small)
        if state == before:  # the steps are deterministic: equal edge sets stay so
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))


def _reach(n: str, m: str, i: str, j: str) -> Column:
    """Whether sets of n and m tokens whose first common prefix token is at i and j can be similar.

    A later common token only allows less, so no pair is lost when each common token is judged so.
    """
    most = f"(1 + least({n} - {i} - 1, {m} - {j} - 1))"
    return F.expr(f"{most} * {NUM + DEN} >= {NUM} * ({n} + {m})")


def _told(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """The prefix tokens that several sets share, with each set's component so far."""
    return shared.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null texts and texts without words have no shingles and are linked with nothing.  Rows of one
    id are one node for the component but keep their own n_shingles; a null id is a node by itself
    only if no other row has a null id, and its component id may be null.  Other columns are not
    read; an empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):  # all Python stages are written in here
        return _components(docs, id_col, text_col)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark, null = docs.sparkSession, -(1 << 63)
    node = F.coalesce(F.col(id_col).cast("long"), F.lit(null))
    rows = docs.select(node.alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("th", F.unhex(F.md5("text")))
    sets = staged(_sets(rows), "sets")
    # every distinct set has a key of its own, in the order of the ids; an id may stand for several sets
    groups = sets.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc", "th")).alias("least"))
    groups = groups.select("sig", F.col("least.doc").alias("rep"), F.col("least.th").alias("th")).orderBy("rep", "th")
    groups = staged(groups.withColumn("key", F.monotonically_increasing_id()), "reps")
    picked = sets.where("n > 0").select("doc", "sig").join(groups.select("sig", "rep"), "sig")
    texts = rows.where("text IS NOT NULL").join(groups.select(F.col("rep").alias("doc"), "th", "key"), ["doc", "th"])
    texts = bucketed(texts.dropDuplicates(["doc", "th"]).select(F.col("key").alias("doc"), "text"), "doc", staged_path(spark, "rep-texts"))
    held = staged_path(spark, "counts")
    buckets = max(partitions(spark), -(-int(sets.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    counted = stored(_tokens_and_sketches(texts, buckets), held)
    common, rank = _common(counted.where("bucket IS NOT NULL").select("bucket", "once", "often", "counts"))
    sketches = bucketed(counted.where("bucket IS NULL").select("doc", "sk"), "doc", staged_path(spark, "sketches"))
    discard(spark, held)
    token = Window.partitionBy("tok")
    shared = _prefixes(texts, common, rank, buckets).withColumns({"a": F.min("doc").over(token), "z": F.max("doc").over(token)})
    shared = staged(shared.where("a < z").drop("z"), "shared-prefixes")  # few: most tokens are of one set
    # one candidate for each set: the smallest set it shares a prefix token with
    star = shared.where("doc > a").groupBy(F.col("doc").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    links = staged(_verify(star, sketches, texts), "links-star")
    for centre in range(CENTRES):
        told = _told(shared, components(links))
        # in large groups not yet of one component: one more candidate a set, by another centre
        large = told.groupBy("tok").agg(
            F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min_by(F.struct("doc", "comp", "n", "pos"), F.xxhash64("comp", F.lit(centre))).alias("c"),
        ).where(F.col("m") >= LARGE).where("lo < hi").select("tok", "c")
        met = told.join(large, "tok").where("comp <> c.comp").where(_reach("n", "c.n", "pos", "c.pos"))
        star = met.groupBy(F.col("doc").alias("x")).agg(F.min_by("c.doc", F.xxhash64("c.doc", F.lit(centre))).alias("y"))
        star = star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = links.unionByName(staged(_verify(star, sketches, texts), "links-star"))
    told = staged(_told(shared, components(links)), "told")
    mixed = told.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok")
    open_ = told.join(mixed, "tok")
    x, y = (open_.select("tok", *[F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "pos", "prev", "comp")]) for side in "ab")
    pairs = x.join(y, "tok").where("doc_a < doc_b AND comp_a <> comp_b").where(_reach("n_a", "n_b", "pos_a", "pos_b"))
    # a pair whose tokens before are equal has met at those: one row for each run of common tokens, the first included
    pairs = pairs.where("coalesce(prev_a <> prev_b, true)")
    pairs = pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()
    links = links.unionByName(staged(_verify(pairs, sketches, texts), "links"))
    for side in "ab":
        links = links.join(groups.select(F.col("key").alias(side), F.col("rep").alias(f"rep_{side}")), side)
    links = links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # rows of one id and several texts hold their sets together
    own = picked.select(F.col("doc").alias("a"), F.col("rep").alias("b")).where("a <> b")
    comp = components(links.unionByName(own))
    none = F.lit(null)
    return sets.join(comp, "doc", "left").select(
        F.when(F.col("doc") != none, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.coalesce("comp", "doc") != none, F.coalesce("comp", "doc")).alias("component_id"),
    )


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON n.doc_id = r.x GROUP BY n.doc_id, n.n
"""
