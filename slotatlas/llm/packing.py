"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous sweeps.

Pieces are range-sorted by length, gaps by size. As lengths and gaps are whole numbers up to the capacity, equal ones
form a run, and all that matters of a run is its size. A sweep takes the longest run of pieces left, finds its
successor (the smallest gap that holds it), matches the two by rank as far as both go, and updates the gaps: the gaps
used become a run of smaller ones, the rest stays. Where no gap is left, new sequences open. Sweeps work on the
histogram (at most one run for each length), never on rows, and yield stretches: pieces `rank_from` to `rank_to` of a
length go to consecutive sequences at one offset. Rows then look up their stretch by their own rank, which is counted
in salted groups, so a length that a third of all pieces share is no hot spot.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotatlas.llm import bpe
from slotatlas.llm.common import materialize

#: Groups into which pieces of one length are dealt for counting. The driver gets capacity * SALTS counts at most.
SALTS = 32
#: Texts longer than this are encoded in stretches of about so many characters. Has no influence on results.
STRETCH_CHARS = 1 << 16
STRETCH = "length int, rank_from long, rank_to long, first_sequence long, offset long"


def stretches(text: str) -> Iterator[str]:
    """Cut a long text at blanks that start a pre-token, so that no list of ids grows with it."""
    at = 0
    while len(text) - at > STRETCH_CHARS and (blank := bpe.STARTS.search(text, at + STRETCH_CHARS)):
        yield text[at:blank.start()]
        at = blank.start()
    yield text[at:]


class StretchEncoder(bpe.TextEncoder):
    """Whole texts to packed ids in stretches, without a memory of words: for merges that take less time than looking up."""

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self._ids(text)) for text in texts]

    def _ids(self, text: str) -> Iterator[bytes]:
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield self.special[part]
            elif part:
                yield from self.encode_pieces(stretches(part))


def quick_encoder(ranks_path: str, vocab: str) -> StretchEncoder:
    """Gives the ids of the encoder of op1, with all merges done by a library from the same vocabulary as ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    merges = tiktoken.Encoding("ranks", pat_str=bpe.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    return StretchEncoder(lambda pieces: (bpe.pack(merges.encode_ordinary(p)) for p in pieces), bpe.special_tokens(vocab))


_ENCODERS: dict[tuple[str, str], StretchEncoder] = {}


def pieces(df: DataFrame, vocab: str, ranks: str, capacity: int = 1024, end_id: int = 2, text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Rows `piece, start, length, ids_crc32` (and packed `ids`) instead of the text: its ids and the end id, cut at capacity.

    Only documents longer than the capacity are cut; their first piece takes what whole pieces leave over. Null is the
    empty text, which has the end id alone. Other columns are carried along.
    """
    def make():
        if (vocab, ranks) not in _ENCODERS:
            _ENCODERS[vocab, ranks] = quick_encoder(ranks, vocab)
        encoder, end = _ENCODERS[vocab, ranks], bpe.pack([end_id])

        def cut(ids: bytes) -> Iterator[tuple]:
            n, start, number = len(ids) // 4, 0, 0
            stop = n % capacity or capacity
            while start < n:
                part = ids[4 * start:4 * stop]
                yield (number, start, stop - start, zlib.crc32(part), *([part] if with_ids else []))
                number, start, stop = number + 1, stop, stop + capacity

        return lambda values: [list(cut(packed + end)) for packed in encoder([x or "" for x in values])]

    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return bpe.map_text(df, text, fields, make, lambda row: 64 + 4 * row[2] * with_ids)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (length, rank_from, rank_to, first_sequence, offset) for pieces counted by length.

    A run of gaps is a range of sequences with the same room. Each step ends a run of pieces or a run of gaps.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, number)
    stretches, opened = [], 0

    def add(room: int, first: int, number: int) -> None:
        if room and number:
            runs.setdefault(room, []).append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = next((g for g in range(length, capacity + 1) if runs.get(g)), None)
            if room is None:
                each = capacity // length  # so many of this length fill a new sequence
                room, first, number = capacity, opened, -(-left // each)
                opened += number
            else:
                first, number = runs[room].pop()
            take = min(left, number)
            stretches.append((length, rank, rank + take, first, capacity - room))
            add(room - length, first, take)
            add(room, first + take, number - take)
            rank, left = rank + take, left - take
    return stretches


def pack(df: DataFrame, order: list[str], capacity: int = 1024) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces with a `length` of at most the capacity.

    `df` is read twice, so hand over a written table. `order` are columns that tell pieces apart (ties are dealt in any
    order). Two pieces never overlap, and a sequence has no gap before its end.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("sequence_id", "offset", "salt", "first_rank")]
    salted = df.select(*own, F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int").alias("salt"))
    counted = salted.groupBy("length", "salt").count().collect()  # capacity * SALTS rows at most
    totals: dict[int, int] = {}
    bases = []
    for length, salt, n in sorted(map(tuple, counted)):
        bases.append((length, salt, totals.get(length, 0)))
        totals[length] = totals.get(length, 0) + n
    base = spark.createDataFrame(bases, "length long, salt int, first_rank long")
    stretches = spark.createDataFrame(sweep(totals, capacity), STRETCH)
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1
    ranked = salted.withColumn("rank", rank).join(F.broadcast(base), ["length", "salt"])  # capacity * SALTS rows
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first_rank")).alias("p")
    hit = (F.col("p.length") == F.col("s.length")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1)
    # a stretch ends a run of pieces or of gaps: a few for each length
    return ranked.join(F.broadcast(stretches.alias("s")), hit).select(
        *(F.col(f"p.`{c}`") for c in own),
        (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, vocab: str, ranks: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Pieces of whole documents with their places: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    Every row of the input is packed, repeated ones too. An empty table gives an empty result.
    """
    made = pieces(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), vocab, ranks, capacity, end_id)
    return pack(materialize(made, "pieces"), ["doc_id", "piece"], capacity)
