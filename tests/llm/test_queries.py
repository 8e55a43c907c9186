"""Registered queries over whole tables, against brute force, and the pipeline stage by stage."""

import collections
import hashlib
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from slotatlas.llm import queries, quality, secrets
from tests.conftest import SF_DIR
from tests.llm import brute


@pytest.fixture(scope="module")
def docs():
    table = pq.read_table(f"{SF_DIR}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


def run(spark, key):
    return queries.QUERIES[key](spark, SF_DIR).collect()


def test_all_are_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_op1(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = run(spark, "op1_bpe")
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), brute.sha(docs[r.doc_id] or ""))


def test_op2(spark, docs):
    for r in run(spark, "op2_quality_rules"):
        want = brute.statistics(docs[r.doc_id])
        assert tuple(r[n] for n in quality.STATISTICS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_op3(spark, docs):
    assert {r.doc_id: (r.class_id, r.n_links) for r in run(spark, "op3_ngram_join")} == brute.links(docs)


def test_op4(spark, docs):
    want = dict(zip(docs, brute.scores(docs.values())))
    assert {r.doc_id: pytest.approx(r.score) for r in run(spark, "op4_lm_score")} == want


def test_op5(spark, docs):
    rows, ids = {r.doc_id: r for r in run(spark, "op5_spot_signatures")}, sorted(docs)
    for k, i in enumerate(ids):
        text, after = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), brute.sha(text[:len(text) - half] + after[:half]))


def test_op6(spark, docs):
    rows, shards = run(spark, "op6_slot_sharding"), collections.defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        shards[r.shard].append(r)
    assert len(rows) == len(docs) and sorted(shards) == list(range(16))
    load = [sum(r["size"] for r in part) for part in shards.values()]
    assert max(load) < 1.1 * min(load)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))


def test_op7(spark, docs):
    for r in run(spark, "op7_secret_scan"):
        spans = brute.secret_spans(docs[r.doc_id] or "")
        kinds = collections.Counter(k for _, _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (kinds["assign"], kinds["access"], kinds["hex"], brute.sha(brute.spelled(spans)))
        assert set(brute.spelled(spans).split(",")) <= {*r.spans.split(","), ""}


def test_op9(spark):
    table = pq.read_table(f"{SF_DIR}/pages.parquet").to_pydict()
    rows = {r.page_id: r for r in run(spark, "op9_warc")}
    assert set(rows) == set(table["page_id"])
    for i, html in zip(table["page_id"], table["html"]):
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())


def test_op11(spark, docs):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in run(spark, "op11_spelling_variants")}
    assert got == brute.spelling_forms(brute.spelling_counts(docs))


def test_op12(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = run(spark, "op12_sentencepiece")
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids)))


def test_op13(spark):
    table = pq.read_table(f"{SF_DIR}/conversations.parquet").to_pydict()
    want = brute.trie(brute.rebuilt(zip(*(table[c] for c in ("conv_id", "turn", "role", "text")))))
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in run(spark, "op13_conversation_trie")}
    assert got == want


def packed_right(rows, texts):
    """Pieces cover every document's ids, and sequences have no gaps."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            packed = b"".join(x.to_bytes(4, "little") for x in ids[at:at + r.length])
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(packed))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_op8(spark, docs):
    rows = run(spark, "op8_best_fit")
    assert packed_right(rows, docs) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_pipeline_stage_by_stage(spark, docs):
    now, seen = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF_DIR)
        if k < 3:
            assert now.columns == corpus_pipeline.COLUMNS
            seen.append({r.doc_id: r for r in now.collect()})
    kept, single, masked = seen
    judged = {r.doc_id: r for r in run(spark, "op2_quality_rules")}
    assert set(kept) == {i for i, r in judged.items() if r.kept}
    labels = pq.read_table(f"{SF_DIR}/labels.parquet").to_pydict()
    good = [i for i, q in zip(labels["doc_id"], labels["quality"]) if q == 1 and not judged[i].base_failed]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    groups = brute.links({i: r.text for i, r in kept.items()})
    assert set(single) == {i for i, (group, _) in groups.items() if i == group}
    assert set(masked) == set(single)
    for i, r in masked.items():
        text = docs[i]
        assert not brute.secret_spans(r.text) and r.n_chars == len(r.text)
        if secrets.MASK not in r.text:
            assert r.text == text
    assert packed_right(now.collect(), {i: r.text for i, r in masked.items()})


def test_pipeline_runs_through(spark):
    out = entry.queries()["pipeline"](spark, SF_DIR)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count()
