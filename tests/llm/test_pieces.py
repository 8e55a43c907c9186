import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from slotatlas.llm import pieces
from slotatlas.llm.bpe import pack, unpack

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b", "a\nb \n c", "▁", "▁a ▁ b", "a▁", "\x00", "a\x00b", "\t\t", "é ñ ß", "東京 タワー", "🙂👩‍👩‍👧 x",
       "ab" * 300, "!" * 3000, " " * 100 + "x", "x" + " " * 33, "�", "ﬁ ① ½ ﷺ", "éá", "<s> </s> <unk> <0x41>", "​­ a", "が が",
       "a" * 47 + " " + "b" * 48 + " " + "c" * 49, "Ａ　Ｂ", "I ⁇ x"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def variant(path, kinds=(), charsmap=b"", fallback=1, suffix=0, **rules):
    """The public model with other types of pieces, another character map or other flags."""
    kinds, out = dict(kinds), b""
    with open(PATH, "rb") as f:
        parts = list(pieces.message(f.read()))
    for number, value in parts:
        if number == 1:
            piece = dict(pieces.message(value))
            name, kind = piece[1].decode(), piece.get(3, 1)
            kind = kinds.get(name, kind)
            if kind == 6 and not fallback:
                kind = 5
            score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
            value = field(1, piece[1]) + field(2, score) + field(3, kind)
        if number == 2:
            value = field(3, 2) + field(4, 32000) + field(24, suffix) + field(35, fallback) + field(40, 0) + field(41, 1) + field(42, 2)
        if number == 3:
            value = field(1, b"own") + field(2, charsmap) + field(3, rules.get("prefix", 1)) + field(4, rules.get("squeeze", 0)) + field(5, 1)
        out += field(number, value)
    path.write_bytes(out)
    return str(path)


def compiled(rule):
    spec = dict(pieces.message(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    return dict(pieces.message(spec))[2]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    letters = list("  \n\tabthe'é▁ß東\x00🙂ﬁ①Ａ　́​が゙½\xa0\xad")
    return ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(n)]


def same(path, texts):
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model(path)
    for text, (packed, places) in zip(texts, own.encode(texts)):
        want = library.encode(text, return_type="proto").pieces
        assert list(unpack(packed)) == [p.id for p in want], ascii(text[:80])
        assert own.spell(packed) == " ".join(str(p.id) for p in want)
        assert np.frombuffer(places, "<u4").reshape(-1, 2).tolist() == [[p.begin, p.end] for p in want], ascii(text[:80])
        assert own.decode(packed) == library.decode([p.id for p in want]), ascii(text[:80])


def test_ids_spans_and_texts_equal_the_library():
    same(PATH, ODD + random_texts(3000))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_maps_record_where_bytes_came_from(tmp_path, rule, squeeze):
    same(variant(tmp_path / "m", charsmap=compiled(rule), squeeze=squeeze), ODD + random_texts(600))


def test_other_kinds_of_models(tmp_path):
    texts = ODD + random_texts(800) + ["the then other thethe athe", "this is the that"]
    same(variant(tmp_path / "a", kinds={"▁the": 5, "th": 5, "at": 5}), texts)
    same(variant(tmp_path / "b", kinds={"the": 4, "ab": 4}), texts)
    same(variant(tmp_path / "c", fallback=0), texts)
    same(variant(tmp_path / "d", prefix=0), texts)
    same(variant(tmp_path / "e", suffix=1), texts)


def test_one_by_one_and_side_by_side_agree():
    own, rng = pieces.Model(PATH), random.Random(3)
    words = ["".join(rng.choices("▁abcdethins", k=rng.randint(1, 30))) for _ in range(2000)]
    for several, flat, count in own.merge_many(words):
        assert flat.tolist() == [s for w in several for s in own.merge_long(w)] and count.sum() == len(flat)


def test_any_ids_decode_like_the_library():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Model(PATH), random.Random(5)
    few = [0, 1, 2, *range(3, 40), 160, 198, 231, 259, 260, 263, 29871, 29896]
    for _ in range(4000):
        ids = rng.choices(few, k=rng.randint(0, 9))
        assert own.decode(pack(ids)) == library.decode(ids), ids


def test_rows_nulls_repeats_long_texts_and_clashing_columns(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, 6, None), (3, "", 7, "y"), (None, "long wörd " * 20000, None, "z"),
            (4, "x" * 30000, 1, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, extra string")
    both = pieces.encode(df, PATH, begin=True, end=True, spans="spans", spelled="spelled", decoded="again")
    out = pieces.decode(both, PATH)
    assert out.columns == ["doc_id", "extra", "n_tokens", "spans", "spelled", "again", "ids", "decoded"]
    got = {(r.doc_id, r.extra): r for r in out.collect()}
    for doc, text, _, extra in rows:
        r, ids = got[doc, extra], library.encode(text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, list(unpack(r.ids)), r.spelled) == (len(ids), ids, " ".join(map(str, ids)))
        assert r.decoded == r.again == library.decode(ids)
        places = np.frombuffer(r.spans, "<u4").reshape(-1, 2)
        assert len(places) == len(ids) and places[-1].tolist() == [len((text or "").encode())] * 2
    assert out.count() == len(rows)
    assert pieces.encode(df.limit(0), PATH).count() == 0
