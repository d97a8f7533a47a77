"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 32 bytes picks, among the white-space positions of a text, those where
it is cut; equal passages of different documents therefore fall into equal chunks wherever they
stand.  Each chunk is encoded once and kept in a bounded cache for the documents that follow.  At
every join of two chunks the words on either side are encoded together; where that differs from
what the chunks give, the window is widened and the join re-encoded until both edges agree.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volscreen.llm.common import _SPACE, as_bytes, mix64, table, text_blocks, tidy

#: On average one white space in CUT ends a chunk (a power of two).
CUT = 128
#: Bytes of chunks, ids and decoded text that a task keeps for reuse.
CACHE_BYTES = 48 << 20
#: Words of new chunks that a task keeps for reuse.
WORDS = 200_000
_SPAN = 32
#: Stands between words that are encoded in one call; a word that holds it is encoded by itself.
_MARK = b"\x01"


def cut_points(buf: np.ndarray) -> np.ndarray:
    """Positions where a word follows a white space at which the rolling hash of _SPAN bytes says cut."""
    gear = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    h = gear[buf]
    step = 1
    while step < _SPAN:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    space = _SPACE[buf]
    at = np.flatnonzero(space[:-1] & ~space[1:])
    return at[(h[at] >> np.uint32(8)) % np.uint32(CUT) == 0] + 1


class ChunkEncoder:
    """Encodes and decodes whole texts with one public tokenizer; exact, with bounded memory."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.word_ids: dict[bytes, bytes] = {}
        self.word_text: dict[bytes, bytes] = {}
        self.room = cache_bytes
        self.encoded = self.reused = self.repaired = 0
        # Without a decoder of its own the tokenizer puts one space between tokens.
        self.glue = b" " if self.tokenizer.decoder is None else None
        self.marker = self.lists([_MARK])[0]
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]

    def lists(self, texts: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [e.ids for e in found]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.lists(texts)]

    def decode(self, ids: bytes) -> bytes:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()

    def _apart(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each word.  Many go to the tokenizer as one text, a one-token marker between them."""
        if len(self.marker) != 1 or any(_MARK in w for w in words):
            yield from self.lists(words)
            return
        glue, mark = b" " + _MARK + b" ", self.marker[0]
        for i in range(0, len(words), 1024):
            some = words[i : i + 1024]
            ids = self.lists([glue.join(some)])[0]
            ends = [*np.flatnonzero(np.array(ids) == mark).tolist(), len(ids)]
            at = 0
            for end in ends:
                yield ids[at:end]
                at = end + 1

    def _fresh(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of new chunks, whose words are chunks of the smallest kind and reused in turn."""
        if self.glue is None:
            return [(ids, self.decode(ids)) for ids in self.ids(chunks)]
        split = [c.split() for c in chunks]
        ids, text = self.word_ids, self.word_text
        if len(ids) > WORDS:
            ids.clear()
            text.clear()
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in ids]
        for w, x in zip(new, self._apart(new), strict=True):
            ids[w] = array("I", x).tobytes()
            text[w] = b" ".join([self.tokens[i] for i in x])
        return [(b"".join([ids[w] for w in ws]), b" ".join([x for w in ws if (x := text[w])])) for ws in split]

    def _learn(self, chunks: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Ids and decoded text of these chunks; new ones enter the cache, the oldest leave it."""
        known = {c: self.cache.get(c) for c in dict.fromkeys(chunks)}
        new = [c for c, v in known.items() if v is None]
        self.encoded += len(new)
        self.reused += len(chunks) - len(new)
        for c, value in zip(new, self._fresh(new), strict=True):
            known[c] = self.cache[c] = value
            self.room -= len(c) + len(known[c][0]) + len(known[c][1])
        while self.room < 0:
            c = next(iter(self.cache))
            ids, text = self.cache.pop(c)
            self.room += len(c) + len(ids) + len(text)
        return known

    def _joins(self, edges: list[tuple[bytes, bytes]], known: dict) -> list[int]:
        """Which of the joins (chunk, next chunk) must be repaired."""
        pairs = [(a.rstrip().rsplit(None, 1)[-1:], b.split(None, 1)[:1]) for a, b in edges]
        pairs = [(x[0] if x else b"", y[0] if y else b"") for x, y in pairs]
        if len(self.joins) > 200_000:
            self.joins.clear()
        new = [p for p in dict.fromkeys(pairs) if p not in self.joins]
        got = self.ids([t for x, y in new for t in (x, y, x + b" " + y)])
        for i, p in enumerate(new):
            self.joins[p] = (got[3 * i], got[3 * i + 1]) if got[3 * i] + got[3 * i + 1] == got[3 * i + 2] else None
        bad = []
        for i, (p, (a, b)) in enumerate(zip(pairs, edges, strict=True)):
            fit = self.joins[p]
            if fit is None or not known[a][0].endswith(fit[0]) or not known[b][0].startswith(fit[1]):
                bad.append(i)
        return bad

    def _repair(self, parts: list[bytes], known: dict, at: list[int]) -> bytes:
        """Ids of a text whose joins ``at`` (before parts[i + 1]) disagree: widen until they agree."""
        self.repaired += len(at)
        groups = [[p] for p in parts]
        for i in reversed(at):
            groups[i : i + 2] = [groups[i] + groups[i + 1]]
        while True:
            texts = [b"".join(g) for g in groups]
            ids = self.ids(texts)
            wrong = []
            for i in range(len(groups) - 1):
                both = self.ids([texts[i] + texts[i + 1]])[0]
                if both != ids[i] + ids[i + 1]:
                    wrong.append(i)
            if not wrong:
                return b"".join(ids)
            for i in reversed(wrong):
                groups[i : i + 2] = [groups[i] + groups[i + 1]]

    def __call__(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each whole text."""
        gap = b" " * _SPAN
        buf = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
        cuts = cut_points(buf) - _SPAN
        begin = np.concatenate([[0], np.cumsum([len(t) + _SPAN for t in texts])])
        lows, highs = np.searchsorted(cuts, begin[:-1], "right"), np.searchsorted(cuts, begin[1:] - _SPAN, "left")
        docs = []
        for t, b, lo, hi in zip(texts, begin[:-1].tolist(), lows.tolist(), highs.tolist(), strict=True):
            at = [0, *(cuts[lo:hi] - b).tolist(), len(t)]
            docs.append([t[x:y] for x, y in zip(at, at[1:], strict=False)] if len(at) > 2 else [t])
        known = self._learn([c for d in docs for c in d])
        edges = [(a, b) for d in docs for a, b in zip(d, d[1:], strict=False)]
        bad = set(self._joins(edges, known)) if edges else set()
        ids, decoded, k = [], [], 0
        for d in docs:
            wrong = [i for i in range(len(d) - 1) if k + i in bad] if bad else []
            k += len(d) - 1
            own = self._repair(d, known, wrong) if wrong else b"".join([known[c][0] for c in d])
            ids.append(own)
            if wrong or self.glue is None:
                decoded.append(self.decode(own))
            else:
                decoded.append(self.glue.join([x for c in d if (x := known[c][1])]))
        return ids, decoded


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, binary), decoded: the exact encoding of each whole text.

    ``tokenizer`` is the path of a tokenizer file present on every worker.  A null or empty text has
    no ids and decodes to the empty string.  Every row gives a row: null and repeated ids are kept;
    other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(tokenizer)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in text_blocks(texts):
                ids, decoded = coder([t or b"" for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids binary, decoded string")


def tokenizer_path(name: str = "word_bpe_49k.json", package_dir: str = "/opt/tokenizers") -> str:
    """Where a public vocabulary file is; the folder is a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(package_dir, name)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()))
