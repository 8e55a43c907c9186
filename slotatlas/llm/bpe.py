"""Byte-level BPE: exact encoding by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token there is exactly one token its encoding can end with. Walking an automaton of all
tokens along the bytes lists the tokens that end at each position; the one that is compatible with the last token of
the prefix before it is stored, and following the stored tokens back from the end gives the ids.

Two neighbouring tokens are compatible when no merge would have joined a piece of the left one with a piece of the
right one before both were complete. See `Vocabulary.compatible`.

The file of the vocabulary is read once in each Python worker, from a path that every node must have.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The public pattern that cuts text before the merges.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of that pattern (the Unicode property).
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))
_WHITE = "".join(sorted(WHITE))
#: Blanks that start a pre-token.
STARTS = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_RARE = [*(set(WHITE) - {" ", "\n"}), "  ", " \n", "\n "]


def parts_of(text: str) -> list[str]:
    """Cut at the blanks that start a pre-token: all blanks of most texts."""
    if text[0] == " " or text[-1] == " " or any(x in text for x in _RARE):
        return STARTS.split(text)
    return text.split(" ")


#: Entries a worker remembers before it starts anew. Has no influence on results.
REMEMBERED = 300_000
#: Pre-tokens up to so many bytes are encoded side by side, longer ones one by one.
SIDE_BY_SIDE = 64
#: Output of about this size is handed to Spark at once.
BATCH_BYTES = 8 << 20
#: Texts of about this size are encoded together.
GROUP_BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the file: printable ones for themselves, the others counted up from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the automaton over all tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        names = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in name) for name, i in names.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.written = self.bytes_of | {i: text.encode() for text, i in self.special.items()}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.rank = dict.fromkeys(self.bytes_of, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = names[a], names[b], names[a + b]
            self.merged[left, right] = rank
            self.halves[whole], self.rank[whole] = (left, right), rank
        self._spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._pairs: dict[int, bool] = {}
        self._step = None

    def _build(self) -> None:
        """Trie of all tokens, completed by links to the longest proper suffix that is a path too.

        `_step[state, byte]` is the next state, `_token[state]` the longest token that ends there, and `_shorter[token]`
        the longest token that is a proper suffix of a token.
        """
        path: dict[int, int] = {}
        token = [-1]
        for i, word in self.bytes_of.items():
            at = 0
            for byte in word:
                key = at << 8 | byte
                if key not in path:
                    path[key] = len(token)
                    token.append(-1)
                at = path[key]
            token[at] = i
        below: list[list[tuple[int, int]]] = [[] for _ in token]
        for key, to in path.items():
            below[key >> 8].append((key & 255, to))
        step = np.zeros((len(token), 256), np.int32)
        link, queue, ends = [0] * len(token), deque([0]), list(token)
        self._shorter = np.full(max(self.bytes_of) + 1, -1, np.int32)
        while queue:
            at = queue.popleft()
            step[at] = step[link[at]]  # the suffix is shorter, so it is complete already
            for byte, to in below[at]:
                link[to] = int(step[at, byte]) if at else 0
                step[at, byte] = to
                if token[to] >= 0:
                    self._shorter[token[to]] = ends[link[to]]
                else:
                    ends[to] = ends[link[to]]
                queue.append(to)
        self._step, self._token = step, np.array(ends, np.int32)
        self._length = np.zeros(len(self._shorter), np.int32)
        self._length[list(self.length)] = list(self.length.values())

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Pieces at the right (1) or left (0) edge of a token, each with the rank of the merge that takes it up."""
        if (token, side) not in self._spines:
            found, until, piece = [], float("inf"), token
            while True:
                found.append((piece, until))
                if piece not in self.halves:
                    break
                until, piece = self.rank[piece], self.halves[piece][side]
            self._spines[token, side] = found
        return self._spines[token, side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both encode as these two tokens.

        A merge across the border happens if its two pieces are at the border when its rank comes up: before the left
        piece is taken up by a merge of its own, and not after the right one is (at equal ranks the leftmost goes first).
        """
        known = self._pairs.get(left << 20 | right)
        if known is None:
            known = not any(
                rank is not None and rank < x_until and rank <= y_until
                for x, x_until in self._spine(left, 1) for y, y_until in self._spine(right, 0)
                for rank in (self.merged.get((x, y)),))
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            self._pairs[left << 20 | right] = known
        return known

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if self._step is None:
            self._build()
        last, at = [], 0
        for end, byte in enumerate(word):
            at = int(self._step[at, byte])
            token = int(self._token[at])
            while (size := self.length[token]) <= end and not self.compatible(last[end - size], token):
                token = int(self._shorter[token])
            last.append(token)
        ids, end = [], len(word)
        while end:
            ids.append(token := last[end - 1])
            end -= self.length[token]
        return ids[::-1]

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens: the same steps, for the same position of all words at a time."""
        if self._step is None:
            self._build()
        short = [k for k, w in enumerate(words) if len(w) <= SIDE_BY_SIDE]
        short.sort(key=lambda k: -len(words[k]))
        packed = [b""] * len(words)
        for k in set(range(len(words))).difference(short):
            packed[k] = pack(self.encode_bytes(words[k]))
        if not short:
            return packed
        size = np.array([len(words[k]) for k in short])
        text = np.zeros((len(short), int(size[0])), np.uint8)
        text[np.arange(text.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words[k] for k in short), np.uint8)
        last = np.zeros(text.shape, np.int32)
        at = np.zeros(len(short), np.int32)
        for end in range(text.shape[1]):
            n = int(np.searchsorted(-size, -end))  # words that go on
            at = self._step[at[:n], text[:n, end]]
            last[:n, end] = token = self._token[at]
            open_ = np.flatnonzero(self._length[token] <= end)
            while len(open_):
                token = last[open_, end]
                left = last[open_, end - self._length[token]]
                open_ = open_[~self._fit(left, token)]
                last[open_, end] = self._shorter[last[open_, end]]
                open_ = open_[self._length[last[open_, end]] <= end]
        rest, back, which = size.copy(), [], np.arange(len(short))
        while len(which):
            token = last[which, rest[which] - 1]
            back.append((which, token))
            rest[which] -= self._length[token]
            which = which[rest[which] > 0]
        owner = np.concatenate([w for w, _ in back[::-1]])
        flat = np.concatenate([t for _, t in back[::-1]])[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(short)))).tolist()
        for k, lo, hi in zip(short, [0, *stops], stops):
            packed[k] = flat[lo:hi]
        return packed

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, where = np.unique(left.astype(np.int64) << 20 | right, return_inverse=True)
        known = self._pairs
        fits = [known[p] if p in known else self.compatible(p >> 20, p & (1 << 20) - 1) for p in pairs.tolist()]
        return np.array(fits, bool)[where]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of texts without special tokens; every different pre-token is encoded once."""
        cut = [_pattern().findall(piece) for piece in pieces]
        words = {w.encode("utf-8", "surrogatepass"): w for found in cut for w in found}
        ids = dict(zip(words.values(), self.encode_many(list(words))))
        return [b"".join(map(ids.__getitem__, found)) for found in cut]


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def _pattern() -> regex.Pattern:
    return regex.compile(PRE_TOKENS)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class TextEncoder:
    """Whole texts to packed ids, remembering pieces between blanks.

    A blank between two characters that are no white space always starts a new pre-token, so what stands between two
    such blanks can be encoded by itself, once.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], special: dict[str, int]):
        self.encode_pieces, self.memo = encode_pieces, {}
        self.special = {text: pack([i]) for text, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        flat: list[list[str]] = []  # plain parts of all texts, cut at blanks; all but the first of each follow a blank
        shape: list[list[object]] = []  # for each text: places in flat, or packed special tokens
        for text in texts:
            plan: list[object] = []
            for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if k % 2:
                    plan.append(self.special[part])
                elif part:
                    plan.append(len(flat))
                    flat.append(parts_of(part))
            shape.append(plan)
        firsts = [parts[0] for parts in flat]
        for parts in flat:
            del parts[0]
        memo = self.memo
        new = list(set().union(*flat) - memo.keys())
        if len(memo) + len(new) > REMEMBERED:
            self.memo = memo = {}
            new = list(set().union(*flat))
        packed = self.encode_pieces(firsts + [" " + part for part in new])
        memo.update(zip(new, packed[len(firsts):]))
        whole = [first + b"".join(map(memo.__getitem__, parts)) for first, parts in zip(packed, flat)]
        return [b"".join(whole[x] if isinstance(x, int) else x for x in plan) for plan in shape]


@functools.cache
def text_encoder(path: str) -> TextEncoder:
    vocab = vocabulary(path)
    return TextEncoder(vocab.encode_pieces, vocab.special)


def unpack(ids: bytes) -> tuple[int, ...]:
    """Ids of a packed value."""
    return struct.unpack(f"<{len(ids) // 4}I", ids)


def decode_ids(vocab: Vocabulary, ids: bytes) -> str:
    """Text of packed ids; special tokens stay as written, unknown ids give nothing, broken UTF-8 becomes U+FFFD."""
    return b"".join(map(vocab.written.get, np.frombuffer(ids, "<u4").tolist(), itertools.repeat(b""))).decode("utf-8", "replace")


def _replaced(df: DataFrame, gone: set[str], added: list[T.StructField]) -> tuple[list[str], T.StructType]:
    """Columns to carry along (those that the result defines anew are not), and the schema of the result."""
    new = {f.name.lower() for f in added} | {g.lower() for g in gone}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    return [f.name for f in kept], T.StructType([*kept, *added])


def _bounded(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples with their size first, as batches of bounded bytes."""
    held, weight = [], 0
    for size, *row in rows:
        held.append(row)
        weight += size
        if weight >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def map_text(df: DataFrame, column: str, fields: list[T.StructField],
             make: Callable[[], Callable[[list], Iterable[list[tuple]]]], weigh: Callable[[tuple], int] = lambda row: 64) -> DataFrame:
    """For each row, the rows that a function makes of one column; the other columns are carried along.

    `make` is called once for each task; the function takes the values of some rows (about a megabyte, or one row) and
    gives a list of new rows for each. Narrow: no shuffle, and memory is bounded by the largest row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept, schema = _replaced(df, {column}, fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()

        def rows():
            for batch in batches:
                sizes = np.cumsum(np.diff(_offsets(batch.column(column)))) // GROUP_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    part = batch.slice(lo, hi - lo)
                    sides = list(zip(*(part.column(name).to_pylist() for name in kept))) or [()] * (hi - lo)
                    for side, made in zip(sides, fn(part.column(column).to_pylist())):
                        for row in made:
                            yield (weigh(row), *side, *row)

        yield from _bounded(rows(), arrow)

    return df.select(*(f"`{c}`" for c in kept), f"`{column}`").mapInArrow(run, schema)


def _offsets(values: pa.Array) -> np.ndarray:
    """Where values begin in the bytes of a string or binary array."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    return np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset:values.offset + len(values) + 1]


def encode(df: DataFrame, vocab: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replace a text column by its token ids (packed, `unpack`) and `n_tokens`; with `decoded`, add their text too.

    Null is encoded like the empty text: no ids. Other columns are kept; one already called like a new one is replaced.
    Decoding in the same pass saves a second Python worker and the way of the ids through the JVM.
    """
    def make():
        known, encoder = vocabulary(vocab), text_encoder(vocab)

        def row(packed: bytes) -> tuple:
            return (packed, len(packed) // 4, *([decode_ids(known, packed)] if decoded else []))
        return lambda values: ([row(packed)] for packed in encoder([x or "" for x in values]))

    fields = [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    return map_text(df, text, fields, make, lambda row: 2 * len(row[0]))


def decode(df: DataFrame, vocab: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of packed token ids; null becomes the empty text. Other columns are kept, `text` is replaced."""
    def make():
        known = vocabulary(vocab)
        return lambda values: ([(x, decode_ids(known, x or b""))] for x in values)

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(text, T.StringType())]
    return map_text(df, ids, fields, make, lambda row: 3 * len(row[1]))
