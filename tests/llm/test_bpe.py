import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slotatlas.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n x", "x  ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>  c",
       "don't we'll 'sa", "\xa0 x\xa0\xa0y", "\x85 x", "a\x1c b", "naïve 東京 100% $5.00", "!" * 3000, "ab" * 2000, " " * 2000 + "x",
       "　x 　y", "é́‍👩‍👧", "٣٤ ²³ ½", "a\x00b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    rng = random.Random(7)
    letters = list(" \n\tab'sé!1<|>\xa0　\x1cZ東")
    return ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(n)]


def test_ids_equal_the_library(library):
    texts = ODD + random_texts(3000)
    for text, packed in zip(texts, bpe.text_encoder(PATH)(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(bpe.unpack(packed)) == ids, text[:60]
        assert bpe.decode_ids(bpe.vocabulary(PATH), packed) == library.decode(ids, skip_special_tokens=False)


def test_one_by_one_and_side_by_side_agree():
    vocab = bpe.vocabulary(PATH)
    words = [w.encode() for t in random_texts(300) for w in t.split()] + [b"a", b"the" * 30]
    assert [list(bpe.unpack(p)) for p in vocab.encode_many(words)] == [vocab.encode_bytes(w) for w in words]


def test_every_token_encodes_as_itself():
    vocab = bpe.vocabulary(PATH)
    tokens = list(vocab.bytes_of)
    assert [bpe.unpack(p) for p in vocab.encode_many([vocab.bytes_of[t] for t in tokens])] == [(t,) for t in tokens]


def test_broken_ids_decode_like_the_library(library):
    vocab = bpe.vocabulary(PATH)
    ids = library.encode("東京 é", add_special_tokens=False).ids
    for part in (ids[1:], ids[:-1], ids[::-1]):
        assert bpe.decode_ids(vocab, bpe.pack(part)) == library.decode(part, skip_special_tokens=False)


def test_rows_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, 6, None), (3, "", 7, "y"), (None, "long word " * 20000, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, extra string")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "extra", "n_tokens", "ids", "decoded"]
    got = {(r.doc_id, r.extra): (r.n_tokens, list(bpe.unpack(r.ids)), r.decoded) for r in out.collect()}
    for doc, text, _, extra in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc, extra] == (len(ids), ids, text or "")
    assert out.count() == len(rows)
    assert bpe.encode(df, PATH, decoded="again").select("again").exceptAll(out.select("decoded")).count() == 0
    assert bpe.encode(df.limit(0), PATH).count() == 0
