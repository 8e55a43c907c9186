"""SentencePiece BPE: exact encoding that keeps offsets, and decoding.

Text is normalised by the longest prefix in the compiled character map of the model, and every byte of the normalised
text remembers the source byte it came from. Merges go on in normalised text; through that alignment every piece is
projected to the bytes of the original text it stands for. Without a character map only blanks change.

Words (a run of word marks and what follows) are merged apart where no piece of the model crosses their border, many of
them side by side in numpy. The model file is read once in each Python worker, from a path that every node must have.

Null is encoded like the empty text. Texts of any length work: what the worker remembers is bounded by bytes, and output
is handed on in bounded batches. Rows are independent, so ties and repeated rows have no influence.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slotatlas.llm.bpe import map_text

#: Types of pieces in a model file, the word mark, and the default text of unknown ids.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
UNKNOWN_TEXT = " ⁇ "
BPE_MODEL = 2

#: Bytes of words a worker remembers before it starts anew. Has no influence on results.
REMEMBERED_BYTES = 160 << 20
#: About what a remembered word costs besides its letters and ids.
WORD_BYTES = 260
#: Words up to so many letters are merged side by side, longer ones one by one.
SIDE_BY_SIDE = 48
#: Symbols take 21 bits: those of the model, then one for each other code point, then the filler.
BITS = 21
FILLER = (1 << BITS) - 1
#: Words merged side by side at a time.
TOGETHER = 8192
NEVER = np.int32(np.iinfo(np.int32).max)


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at:at + size]
        at += size


def compiled_map(blob: bytes) -> dict[str, str]:
    """All entries of a compiled character map: a double-array trie over prefixes, then the texts they become."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size:]
    labels = np.arange(1, 256)

    def children_at(place: int) -> int:
        unit = int(units[place])
        return place ^ ((unit >> 10) << ((unit & 512) >> 6))

    found, open_ = {}, [(0, b"")]
    while open_:
        place, key = open_.pop()
        base = children_at(place)
        if key and int(units[place]) >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            found[key.decode()] = texts[start:texts.index(b"\0", start)].decode()
        places = base ^ labels
        inside = places < len(units)
        hit = inside & ((units[np.where(inside, places, 0)] & 0x800000FF) == labels)
        open_.extend((int(base ^ b), key + bytes([b])) for b in labels[hit].tolist())
    return found


class Normalizer:
    """Normalised text, and for each of its bytes (and its end) the source byte it came from."""

    def __init__(self, entries: dict[str, str], keep: list[str], prefix: bool, squeeze: bool, mark: str, suffix: bool):
        self.entries, self.squeeze, self.mark = entries, squeeze, mark
        self.prefix, self.suffix = prefix and not suffix, prefix and suffix
        self.sizes: dict[str, list[int]] = {}
        for key in entries:
            self.sizes.setdefault(key[0], []).append(len(key))
        self.sizes = {first: sorted(set(sizes), reverse=True) for first, sizes in self.sizes.items()}
        kept = "|".join(map(re.escape, sorted(keep, key=len, reverse=True)))
        first = f"[{''.join(map(re.escape, self.sizes))}]" if entries else ""
        self.spots = re.compile("|".join(filter(None, (f"({kept})" if kept else "", first)))) if kept or entries else None

    def _mapped(self, text: str) -> tuple[str, list[tuple[int, int, int]]]:
        """Text after the map, with its replaced parts as (place, bytes, source bytes), in order of the result."""
        out, parts, at, place, done = [], [], 0, 0, 0
        while spot := self.spots.search(text, at):
            lo = spot.start()
            if spot.lastindex:
                at = spot.end()  # symbols of the user stay as they are
                continue
            size = next((n for n in self.sizes[text[lo]] if text[lo:lo + n] in self.entries), 0)
            if not size:
                at = lo + 1
                continue
            plain, key = text[done:lo], text[lo:lo + size]
            new = self.entries[key]
            place += len(plain.encode())
            parts.append((place, len(new.encode()), len(key.encode())))
            place += parts[-1][1]
            out += plain, new
            at = done = lo + size
        return "".join([*out, text[done:]]), parts

    def __call__(self, text: str, aligned: bool = True) -> tuple[str, np.ndarray | None]:
        mapped, parts = self._mapped(text) if self.spots else (text, [])
        body = re.sub(" +", " ", mapped.lstrip(" ")) if self.squeeze else mapped
        if not body:
            return "", np.zeros(1, np.int64) if aligned else None
        normal = self.mark * self.prefix + body.replace(" ", self.mark)
        if self.squeeze:
            normal = normal.rstrip(self.mark)
        if not aligned:
            return normal + self.mark * self.suffix, None
        data = np.frombuffer(mapped.encode(), np.uint8)
        source = self._source(len(data), parts, len(text.encode()))
        blank, begin, end = data == 32, 0, source[-1]
        if self.squeeze:
            begin = source[len(mapped) - len(mapped.lstrip(" "))]
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            blank, source = blank[keep], source[:-1][keep]
        wide = len(self.mark.encode())
        source = np.repeat(source[:len(blank)], np.where(blank, wide, 1))
        source = np.concatenate([[begin] * (wide * self.prefix), source, [end]])
        if self.squeeze:  # marks at the end are gone
            source = source[:len(normal.encode()) + 1]
        return normal + self.mark * self.suffix, np.concatenate([source, [source[-1]] * (wide * self.suffix)]).astype(np.int64)

    @staticmethod
    def _source(size: int, parts: list[tuple[int, int, int]], source_size: int) -> np.ndarray:
        """Source byte of each mapped byte: one after the other, but all bytes of a replaced part have its first."""
        step = np.ones(size + 1, np.int64)
        step[0] = 0
        for place, new, old in parts:
            if new:
                step[place + 1:place + new] = 0
                step[place + new] = old
            else:
                step[place] += old
        source = np.cumsum(step)
        source[-1] = source_size
        return source


class Model:
    """Pieces, merges and the normalizer of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(message(f.read()))
        trainer = dict(message(next((v for n, v in parts if n == 2), b"")))
        rules = dict(message(next((v for n, v in parts if n == 3), b"")))
        if trainer.get(3, 1) != BPE_MODEL:
            raise ValueError("only models of type BPE are read")
        pieces = [dict(message(v)) for n, v in parts if n == 1]
        self.names = [p.get(1, b"").decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        special = {name: i for i, name in enumerate(self.names) if self.kinds[i] in (UNKNOWN, CONTROL)}
        self.unknown = next(i for i, kind in enumerate(self.kinds) if kind == UNKNOWN)
        self.begin = special.get(trainer.get(46, b"<s>").decode(), -1)
        self.end = special.get(trainer.get(47, b"</s>").decode(), -1)
        self.unknown_text = trainer.get(44, UNKNOWN_TEXT.encode()).decode()
        self.fallback = bool(trainer.get(35, 0))
        self.bytes = {int(self.names[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == BYTE}
        self.strips, self.strips_all = bool(rules.get(3, 1) or rules.get(4, 1)), bool(rules.get(4, 1))
        self.own = {name: i for i, name in enumerate(self.names) if self.kinds[i] == USER_DEFINED}
        self.normalize = Normalizer(compiled_map(rules.get(2, b"")), list(self.own), bool(rules.get(3, 1)), bool(rules.get(4, 1)),
                                    MARK if rules.get(5, 1) else " ", bool(trainer.get(24, 0)))
        self._merges(scores)
        self._borders()
        self.written = [self._written(i) for i in range(len(pieces))]
        self.decimal = [str(i) for i in range(len(pieces))]
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    def _merges(self, scores: list[float]) -> None:
        """Symbols (pieces that merges can form, and letters), and for each pair of them the piece it makes."""
        whole = {name: i for i, name in enumerate(self.names) if self.kinds[i] in (NORMAL, USER_DEFINED, UNUSED)}
        letters = {c for name in whole for c in name}
        symbols = list(whole) + sorted(letters - whole.keys())
        number = {name: k for k, name in enumerate(symbols)}
        self.symbols, self.n_symbols = symbols, len(symbols)
        self.id_of = np.array([whole.get(name, -1) for name in symbols], np.int64)
        self.width_of = np.array([len(name.encode()) for name in symbols], np.int64)
        self.pair_of = np.stack([np.maximum(self.id_of, 0), self.width_of], 1).astype("<u4")
        self.plain = np.array([name in whole and self.kinds[whole[name]] != UNUSED for name in symbols] + [False], bool)
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + self.n_symbols
        for c in letters:
            self.symbol_of[ord(c)] = number[c]
        order = {score: rank for rank, score in enumerate(sorted({scores[i] for i in whole.values()}, reverse=True))}
        self.rank_of = np.array([order[scores[whole[name]]] if name in whole else NEVER for name in symbols], np.int32)
        self.pairs: dict[int, int] = {}
        for name in whole:
            for cut in range(1, len(name)):
                left, right = number.get(name[:cut]), number.get(name[cut:])
                if left is not None and right is not None:
                    self.pairs[left << BITS | right] = number[name]
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], np.int32)

    def _borders(self) -> None:
        """Pattern of words that no piece reaches beyond; whole texts where pieces do."""
        names = [name for i, name in enumerate(self.names) if self.kinds[i] in (NORMAL, USER_DEFINED, UNUSED)]
        if any(re.search(f"[^{MARK}]{MARK}", name) for name in names):
            self.words = re.compile(r"(?s).+")
        elif any("\n" in name for name in names):
            self.words = re.compile(f"{MARK}*+[^{MARK}]+|{MARK}+")
        else:
            self.words = re.compile(f"{MARK}*+[^{MARK}\n]+|{MARK}+|\n")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None

    def _made(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of two symbols."""
        key = left.astype(np.int64) << BITS | right
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        made = self.made[spot]
        return np.where(self.keys[spot] == key, self.rank_of[made], NEVER), made

    def merge_many(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words with the symbols of all of them one after the other, and how many each has.

        Words of like length go side by side: in each round the best pair of every word (the leftmost of equals) is
        merged, so all that go on have the same number of symbols fewer.
        """
        words = sorted(words, key=len)
        for k in range(0, len(words), TOGETHER):
            yield self._merged(words[k:k + TOGETHER])

    def _merged(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        now = np.full((len(words), int(size.max())), FILLER, np.int32)
        now[np.arange(now.shape[1]) < size[:, None]] = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        rank, _ = self._made(now[:, :-1], now[:, 1:])
        which, done = np.arange(len(words)), []
        while len(which):
            width = now.shape[1]
            at = rank.argmin(1) if width > 1 else np.zeros(len(which), np.int64)
            go = rank[np.arange(len(which)), at] < NEVER if width > 1 else np.zeros(len(which), bool)
            if not go.all():
                rows = now[~go]
                there = rows != FILLER
                done.append((which[~go], rows[there], there.sum(1)))
                which, now, rank, at = which[go], now[go], rank[go], at[go]
                if not len(which):
                    break
            lines, columns = np.arange(len(which)), np.arange(width - 1)
            now[lines, at] = self._made(now[lines, at], now[lines, at + 1])[1]
            now = now[lines[:, None], columns + (columns > at[:, None])]
            if width > 2:
                rank = rank[lines[:, None], columns[:-1] + (columns[:-1] >= at[:, None])]
                for near in (at - 1, at):
                    ok = (near >= 0) & (near < width - 2)
                    a, b = lines[ok], near[ok]
                    rank[a, b] = self._made(now[a, b], now[a, b + 1])[0]
        order, flat, count = (np.concatenate(x) for x in zip(*done))
        return [words[k] for k in order.tolist()], flat, count

    def merge_long(self, word: str) -> list[int]:
        """Symbols of one long word: the same merges from a heap."""
        now = self.symbol_of[np.frombuffer(word.encode("utf-32-le"), "<u4")].tolist()
        ahead, back = [*range(1, len(now)), -1], list(range(-1, len(now) - 1))
        rank_of, pairs, heap = self.rank_of.tolist(), self.pairs, []

        def offer(left: int) -> None:
            made = pairs.get(now[left] << BITS | now[ahead[left]])
            if made is not None:
                heap.append((rank_of[made], left, now[left], now[ahead[left]], made))

        for left in range(len(now) - 1):
            offer(left)
        heapq.heapify(heap)
        while heap:
            _, left, a, b, made = heapq.heappop(heap)
            right = ahead[left]
            if right < 0 or now[left] != a or now[right] != b:
                continue
            now[left], now[right], ahead[left] = made, -1, ahead[right]
            ahead[right] = -1
            if ahead[left] >= 0:
                back[ahead[left]] = left
            for near in (back[left], left):
                if near >= 0 and ahead[near] >= 0:
                    key = now[near] << BITS | now[ahead[near]]
                    if key in pairs:
                        heapq.heappush(heap, (rank_of[pairs[key]], near, now[near], now[ahead[near]], pairs[key]))
        return [s for s in now if s >= 0]

    def _spelled(self, symbol: int) -> Iterator[tuple[int, int]]:
        """Ids of one symbol, each with the bytes of normalised text it stands for."""
        if symbol < self.n_symbols:
            if self.plain[symbol]:
                yield int(self.id_of[symbol]), int(self.width_of[symbol])
                return
            name = self.symbols[symbol]
            if self.id_of[symbol] >= 0 and len(name) > 1:  # an unused piece falls back to what it was merged from
                for part in self._halves(name):
                    yield from self._spelled(part)
                return
            if self.id_of[symbol] >= 0:
                yield int(self.id_of[symbol]), len(name.encode())
                return
        else:
            name = chr(symbol - self.n_symbols)
        data = name.encode("utf-8", "surrogatepass")
        if self.fallback:  # the last byte stands for the whole letter
            yield from ((self.bytes[b], 0) for b in data[:-1])
            yield self.bytes[data[-1]], len(data)
        else:
            yield self.unknown, len(data)

    @functools.cache
    def _halves(self, name: str) -> list[int]:
        """The last two symbols that are merged to form a piece."""
        letters = self.symbol_of[[ord(c) for c in name]].tolist()
        while len(letters) > 2:
            made = [self.pairs.get(a << BITS | b) for a, b in zip(letters, letters[1:])]
            _, k, m = min((int(self.rank_of[m]), k, m) for k, m in enumerate(made) if m is not None)
            letters[k:k + 2] = [m]
        return letters

    def learn(self, words: list[str]) -> None:
        """Remember packed pairs of id and width (bytes of normalised text) of new words."""
        slow = [(w, self.merge_long(w)) for w in words if len(w) > SIDE_BY_SIDE]
        memo = self.memo
        for several, flat, count in self.merge_many([w for w in words if len(w) <= SIDE_BY_SIDE]):
            stops = np.cumsum(count)
            plain = self.plain[np.minimum(flat, self.n_symbols)]
            odd = np.unique(np.repeat(np.arange(len(count)), count)[~plain]).tolist()
            slow += [(several[k], flat[stops[k] - count[k]:stops[k]].tolist()) for k in odd]
            pairs = self.pair_of[np.minimum(flat, self.n_symbols - 1)].tobytes()
            stops = (8 * stops).tolist()
            memo.update((w, pairs[lo:hi]) for w, lo, hi in zip(several, [0, *stops], stops))
            self.memo_bytes += WORD_BYTES * len(several) + 8 * len(flat)
        for word, symbols in slow:
            memo[word] = pairs = np.array([x for s in symbols for x in self._spelled(s)], "<u4").tobytes()
            self.memo_bytes += WORD_BYTES + 4 * len(word) + len(pairs)

    def encode(self, texts: list[str], spans: bool = True) -> list[tuple[bytes, bytes | None]]:
        """For each text: packed ids, and packed (begin, end) source bytes of each."""
        flat, sources = [], []
        for text in texts:
            normal, source = self.normalize(text, spans)
            found: list[str] = []
            for k, part in enumerate(self.cut.split(normal) if self.cut else [normal]):
                found += [part] if k % 2 else self.words.findall(part)
            flat.append(found)
            sources.append(source)
        if self.memo_bytes > REMEMBERED_BYTES:
            self.memo, self.memo_bytes = {}, 0
        new = set().union(*flat) - self.memo.keys()
        for name in new & self.own.keys():
            self.memo[name] = struct.pack("<II", self.own[name], len(name.encode()))
        self.learn(list(new - self.own.keys()))
        return [self._row(found, source) for found, source in zip(flat, sources)]

    def _row(self, found: list[str], source: np.ndarray | None) -> tuple[bytes, bytes | None]:
        pairs = np.frombuffer(b"".join(map(self.memo.__getitem__, found)), "<u4").reshape(-1, 2)
        flat, widths = pairs[:, 0], pairs[:, 1]
        if not self.fallback:  # a run of unknown letters is one id
            heads = np.flatnonzero(~((flat == self.unknown) & np.concatenate([[False], flat[:-1] == self.unknown])))
            if len(heads) < len(flat):
                widths, flat = np.add.reduceat(widths, heads), flat[heads]
        ids = flat.tobytes()
        if source is None:
            return ids, None
        stops = np.zeros(len(widths) + 1, np.int64)
        np.cumsum(widths, out=stops[1:])
        places = source[stops].astype("<u4")
        spans = np.stack([places[:-1], places[1:]], 1)
        if self.fallback:  # a byte before the last of its letter stands for nothing
            empty = widths == 0
            spans[empty, 1] = spans[empty, 0]
        return ids, spans.tobytes()

    def spell(self, ids: bytes) -> str:
        """Packed ids in decimals, joined by blanks."""
        return " ".join(map(self.decimal.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _written(self, i: int) -> bytes:
        kind, name = self.kinds[i], self.names[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unknown_text.encode()
        if kind == BYTE:
            return bytes([int(name[3:5], 16)])
        return name.replace(MARK, " ").encode()

    def decode(self, ids: bytes) -> str:
        """Text of packed ids: the word mark that normalisation put first goes, control ids give nothing, and each
        byte that is no UTF-8 becomes U+FFFD."""
        flat, head, at = np.frombuffer(ids, "<u4").tolist(), b"", 0
        while self.strips and at < len(flat) and not head:
            i = flat[at]
            at += 1
            name = self.names[i]
            if self.kinds[i] in (NORMAL, USER_DEFINED, UNUSED) and name.startswith(MARK):
                head = name[1:].replace(MARK, " ").encode()
                if not self.strips_all:
                    break
            else:
                head = self.written[i]
        return (head + b"".join(map(self.written.__getitem__, flat[at:]))).decode("utf-8", "each_byte")


codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", begin: bool = False, end: bool = False,
           spans: str | None = None, spelled: str | None = None, decoded: str | None = None) -> DataFrame:
    """Replace a text column by its piece ids (packed, `bpe.unpack`) and `n_tokens`.

    `begin` and `end` put the id of that control piece first or last. `spans` names a column for the original bytes of
    each id, packed (begin, end) pairs; `spelled` one for the ids in decimals, joined by blanks; `decoded` one for the
    text of the ids. Null is encoded like the empty text. Other columns are kept; one already called like a new one
    is replaced. Narrow: no shuffle, memory bounded by the largest row.
    """
    def make():
        known = model(path)

        def row(value: str, packed: bytes, places: bytes | None) -> tuple:
            if begin:
                packed = struct.pack("<I", known.begin) + packed
                places = None if places is None else bytes(8) + places
            if end:
                packed = packed + struct.pack("<I", known.end)
                places = None if places is None else places + struct.pack("<I", len(value.encode())) * 2
            return (packed, len(packed) // 4, *([places] if spans else []), *([known.spell(packed)] if spelled else []),
                    *([known.decode(packed)] if decoded else []))

        def rows(values):
            texts = [x or "" for x in values]
            return ([row(t, *made)] for t, made in zip(texts, known.encode(texts, spans is not None)))
        return rows

    fields = [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(spans, T.BinaryType())] if spans else []
    fields += [T.StructField(name, T.StringType()) for name in (spelled, decoded) if name]
    return map_text(df, text, fields, make, lambda row: 6 * len(row[0]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of packed piece ids; null becomes the empty text. Other columns are kept, `text` is replaced."""
    def make():
        known = model(path)
        return lambda values: ([(x, known.decode(x or b""))] for x in values)

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(text, T.StringType())]
    return map_text(df, ids, fields, make, lambda row: 3 * len(row[1]))
