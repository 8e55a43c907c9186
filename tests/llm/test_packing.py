import collections
import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from slotatlas.llm import bpe, packing

VOCAB, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps, opened = collections.Counter(), 0
    for length in sorted(lengths, reverse=True):
        room = next((g for g in range(length, capacity + 1) if gaps[g]), None)
        if room is None:
            room, opened = capacity, opened + 1
        else:
            gaps[room] -= 1
        gaps[room - length] += 1
    return opened


def test_sweeps_open_as_many_sequences_as_best_fit():
    rng = random.Random(3)
    for capacity in (1, 7, 64, 1024):
        for _ in range(20):
            lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.randint(0, 400))]
            stretches = packing.sweep(collections.Counter(lengths), capacity)
            used = collections.defaultdict(list)
            for length, lo, hi, first, offset in stretches:
                for k in range(hi - lo):
                    used[first + k].append((offset, length))
            assert len(used) == best_fit(lengths, capacity)
            assert collections.Counter(n for s in used.values() for _, n in s) == collections.Counter(lengths)
            for pieces in used.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= capacity


def test_whole_documents_nulls_repeats_and_long_texts(spark):
    texts = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "word " * 3000), (None, "x"), (5, "w" * 5), (6, "one two " * 512)]
    df = spark.createDataFrame([(i, t, "e") for i, t in texts], "doc_id long, text string, offset string")
    rows = packing.pack_documents(df, VOCAB, RANKS, capacity=64).collect()
    library = Tokenizer.from_file(VOCAB)
    want = collections.Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, lo, hi - lo, zlib.crc32(bpe.pack(ids[lo:hi]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for o2, n in pieces if o2 < o) for o, _ in sorted(pieces)]
    assert packing.pack_documents(df.limit(0), VOCAB, RANKS).count() == 0


def test_encoder_gives_the_ids_of_the_tokenizer(monkeypatch):
    library, rng = Tokenizer.from_file(VOCAB), random.Random(5)
    bits = ["a", "The", "é", "ß", "中文", "'s", "'S", "12", "!?", "_", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000",
            "\u200b", "\ufeff", "\U0001f600", "e\u0301", "<|endoftext|>", "<|endoftext", "x" * 40]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices([*bits, " word"], k=3000)) for _ in range(5)]
    texts += ["", " ", "<|endoftext|>", " <|endoftext|> ", " a", "a ", "w" * 5000, "a" + " " * 5000 + "b"]
    want = [bpe.pack(library.encode(t, add_special_tokens=False).ids) for t in texts]
    encoder = packing.quick_encoder(RANKS, VOCAB)
    assert encoder(texts) == want
    for chars in (1, 7, 500):
        monkeypatch.setattr(packing, "STRETCH_CHARS", chars)
        assert all("".join(packing.stretches(t)) == t for t in texts)
        assert encoder(texts) == want


def test_encoder_calls_the_library_once_for_a_text(monkeypatch):
    """not once for each new word; only long texts go in stretches."""
    import tiktoken

    calls, plain = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(len(text)) or plain(self, text))
    packing.quick_encoder(RANKS, VOCAB)([" ".join(f"w{k}" for k in range(1000)), "one two"])
    assert len(calls) == 2
    calls.clear()
    packing.quick_encoder(RANKS, VOCAB)(["word " * 100_000])
    assert max(calls) < 2 * packing.STRETCH_CHARS and sum(calls) == 500_000
