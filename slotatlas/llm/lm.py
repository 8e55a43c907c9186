"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Three steps. (1) Documents are dealt into blocks by hash of their id; each block counts its distinct n-grams, hashed to
64 bits, and deals them by the leading bits of the hash: the parts of the count tables. (2) Each part adds up the corpus counts of its n-grams and gives every
block of documents the counts of the n-grams that the block holds, and all blocks its number of words. (3) Blocks join
the counts to the n-grams of their documents and sum the scores for each document.

What travels are sorted, packed arrays of distinct n-grams: an n-gram that occurs everywhere is one entry for each
block, so there are no hot keys, and no row for each n-gram in a text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotatlas.llm.common import shuffle_partitions
from slotatlas.llm.ngram_join import WORD

#: Factor for each step down to a shorter n-gram.
BACKOFF = 0.4
#: Texts of about this size are counted together before they are handed on.
HELD_BYTES = 32 << 20
#: Packed counts of about this size are handed to Spark at once.
DEALT_BYTES = 2 << 20
#: Entries a worker remembers before it starts anew. Has no influence on results.
REMEMBERED = 500_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Grams:
    """Hashes of the n-grams of a text, for every order up to `order`, at the place of their last word."""

    def __init__(self, order: int):
        self.order, self.memo = order, {}

    def __call__(self, text: str | None) -> list[np.ndarray]:
        words = WORD.findall(text or "")
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        grams = [np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))]
        for _ in range(1, self.order):
            longer = (grams[-1][:-1] * np.uint64(_MIX[0]) ^ grams[0][len(grams):]) * np.uint64(_MIX[1])
            grams.append(longer ^ (longer >> np.uint64(29)))
        return grams


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def expand(packed: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def count_parts(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Distinct n-grams with their counts, block by block, for each (order, part) that a stretch of documents touches.

    `docs` has `block, text`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = Grams(order)
        held: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        size = 0
        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                for n, grams in enumerate(grams_of(text)):
                    if len(grams):
                        held[n, block].append(grams)
                size += len(text)
                if size >= HELD_BYTES:
                    yield from _dealt(held, order, bits)
                    size = 0
        yield from _dealt(held, order, bits)

    return docs.select("block", "text").mapInArrow(run, "gram_order int, part int, blocks binary, sizes binary, grams binary, counts binary")


def _dealt(held: dict[tuple[int, int], list[np.ndarray]], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows, some megabytes at a time; what is held is given up on the way."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = ["gram_order", "part", "blocks", "sizes", "grams", "counts"]
    for n in range(order):
        distinct = []  # for each block: n-grams in order, their counts, and where the parts begin and end
        for block in [of for o, of in held if o == n]:
            grams, counts = np.unique(np.concatenate(held.pop((n, block))), return_counts=True)
            distinct.append((block, grams, counts.astype(np.uint32), [0, *np.searchsorted(grams, edges).tolist(), len(grams)]))
        out, size = [], 0
        for part in range(1 << bits):
            rows = [(block, grams[cuts[part]:cuts[part + 1]], counts[cuts[part]:cuts[part + 1]])
                    for block, grams, counts, cuts in distinct if cuts[part] < cuts[part + 1]]
            if rows:
                blocks, grams, counts = zip(*rows)
                steps = np.concatenate([np.diff(g, prepend=np.uint64(0)) for g in grams])
                out.append((n, part, np.array(blocks, np.int32).tobytes(), np.array([len(g) for g in grams], np.int32).tobytes(),
                            squeeze(steps), squeeze(np.concatenate(counts))))
                size += sum(map(len, out[-1][2:]))
            if out and (size >= DEALT_BYTES or part + 1 == 1 << bits):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out, size = [], 0


def corpus_counts(parts: DataFrame, n_blocks: int) -> DataFrame:
    """For each (block, order, part): corpus counts of the block's distinct n-grams there, in the order of their hashes.

    A part of single words also tells every block how many words of the corpus it has counted: over all parts, all words.
    """
    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        blocks, grams, counts = [], [], []
        for b, s, g, c in zip(rows["blocks"], rows["sizes"], rows["grams"], rows["counts"]):
            sizes = np.frombuffer(s, np.int32)
            steps = expand(g, np.uint64)
            blocks.append(np.repeat(np.frombuffer(b, np.int32), sizes))
            whole = np.cumsum(steps, dtype=np.uint64)  # runs on over the borders of blocks: take off what came before
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            before = np.where(starts > 0, whole[starts - 1], np.uint64(0))
            grams.append(whole - np.repeat(before, sizes))
            counts.append(expand(c, np.uint32))
        blocks, grams = np.concatenate(blocks), np.concatenate(grams)
        names, where = np.unique(grams, return_inverse=True)
        total = np.bincount(where, np.concatenate(counts).astype(np.float64)).astype(np.uint64)
        asked = np.unique(blocks.astype(np.int64) * len(names) + where)  # (block, n-gram) once, in order
        owner, gram = np.divmod(asked, len(names))
        cuts = np.flatnonzero(np.diff(owner)) + 1
        part = int(rows["part"].iloc[0])
        order = int(rows["gram_order"].iloc[0])
        packed = {int(o[0]): squeeze(total[g]) for o, g in zip(np.split(owner, cuts), np.split(gram, cuts))}
        words = 0 if order else int(total.sum())
        made = [(b, order, part, packed.get(b, b""), words) for b in (packed if order else range(n_blocks))]
        return pd.DataFrame(made, columns=["block", "gram_order", "part", "totals", "words"])

    return parts.groupBy("gram_order", "part").applyInPandas(add_up, "block int, gram_order int, part int, totals binary, words long")


def score_blocks(docs: DataFrame, totals: DataFrame, order: int, held_out: bool) -> DataFrame:
    """`doc_id, n_words, score, mean_score` from documents and the counts of their blocks."""
    def score(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        grams_of = Grams(order)
        texts = [grams_of(t) for t in rows["text"]]  # none for a block without documents
        words = int(counts["words"].sum())
        levels = []  # for each order: for each text the corpus counts at each place, and the text's own
        for n in range(order):
            mine = counts[counts["gram_order"] == n].sort_values("part")["totals"]
            total = np.concatenate([np.zeros(0, np.uint64), *(expand(t, np.uint64) for t in mine if t)])
            flat = np.concatenate([np.zeros(0, np.uint64), *(t[n] if len(t) > n else [] for t in texts)]).astype(np.uint64)
            _, where = np.unique(flat, return_inverse=True)
            ends = np.cumsum([len(t[n]) if len(t) > n else 0 for t in texts])[:-1]
            levels.append(np.split(total[where].astype(np.float64), ends) if len(flat) else [np.zeros(0)] * len(texts))
        made = []
        for k, grams in enumerate(texts):
            size = len(grams[0])
            seen = []
            for n in range(order):
                count = levels[n][k]
                if held_out and len(count):
                    _, at, own = np.unique(grams[n], return_inverse=True, return_counts=True)
                    count = count - own[at]
                seen.append(count)
            made.append((size, backed_off(seen, words - size * held_out)))
        out = pd.DataFrame({"doc_id": rows["doc_id"], "n_words": [m[0] for m in made], "score": [m[1] for m in made]})
        out["mean_score"] = [s / n if n else 0.0 for n, s in made]
        return out

    return docs.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, "doc_id long, n_words long, score double, mean_score double")


def backed_off(seen: list[np.ndarray], words: int) -> float:
    """Sum of log10 scores over the places of a text, from the counts of the n-grams that end there.

    The longest n-gram with a count gives count / count of its beginning, times BACKOFF for each shorter order; a word
    without a count gives what half a word in the corpus would.
    """
    size = len(seen[0])
    if not size:
        return 0.0
    best = np.where(seen[0] > 0, seen[0], 0.5) / max(words, 1)
    for n in range(1, len(seen)):
        # seen[n][i] ends at word n + i and begins with the n-gram of one word less that ends at n + i - 1
        found = np.zeros(size, bool)
        found[n:] = seen[n] > 0
        ratio = np.zeros(size)
        ratio[n:] = seen[n] / np.maximum(seen[n - 1][:len(seen[n])], 1)
        tried = np.arange(size) >= n
        best = np.where(found, ratio, np.where(tried, BACKOFF * best, best))
    return float(np.log10(best).sum())


def score(df: DataFrame, order: int = 2, held_out: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_words, score, mean_score` for every row: log10 stupid-backoff scores, summed and by word.

    Counts are those of all texts; with `held_out`, a text's own n-grams are taken off before it is scored, so a text is
    not judged by itself (copies of it still count). Null and empty texts have no words and score 0. Repeated rows are
    separate texts.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    bits = max(2, math.ceil(math.log2(parts)))
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n_blocks = 2 * parts
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    dealt = docs.repartition(parts, "block")  # shuffled once: counting and scoring read the same exchange
    return score_blocks(dealt, corpus_counts(count_parts(dealt, order, bits), n_blocks), order, held_out)
