import hashlib
import random

from slotatlas.llm import warc

EVIL = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30


def test_round_trip_with_copies_and_odd_payloads(spark, tmp_path):
    big, pages = "x" * 999, []
    for k, html in enumerate([None, "", "a", big, big, big + "y", big + "y", big + "y", EVIL, EVIL, "é👩" * 400, "\r\n\r\n", "\n", "long " * 100000]):
        pages.append((k, f"http://Sub{k % 3}.Example.com:80/p?q={k}", html, "clash"))
    pages += [(20, None, "u", "c"), (21, "not a url \r\n at all", big + "y", "c"), (20, None, "u", "c"), (22, "http://[broken", "v", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, archive string")
    rows = warc.archive(df, str(tmp_path / "w")).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    for i, _, html, _ in pages:
        data = (html or "").encode()
        last = max(j for j, _, h, _ in pages if (h or "") == (html or ""))
        revisit = len(data) >= 1000 and i != last
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", last) if revisit else ("response", None))
    keys = [(r.url_key, r.captured_at, r.page_id) for r in rows]
    assert keys == sorted(keys)


def test_empty_table_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "http://a.b/", "x" * 2000), (None, "http://a.b/", "x" * 2000)], "page_id long, url string, html string")
    assert [r.record_type for r in warc.archive(df, str(tmp_path / "n")).collect()] == ["response"] * 2
    assert warc.archive(df.limit(0), str(tmp_path / "e")).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), k, j) for j in range(rng.randint(0, 6))) for k in range(rng.randint(0, 7))]
        assert list(warc.LoserTree(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_url_keys_turn_hosts_round():
    assert warc.url_key("HTTP://www.Example.com/A?b") == "com,example,www)/a?b"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key("") == ")/"


def test_ids_of_any_size(spark, tmp_path):
    ids = [-2**63, -10**13, 0, 3 * 10**11, 10**13, 10**13 + 1, 2**63 - 1]
    df = spark.createDataFrame([(i, "http://a.b/", f"text {i}") for i in ids], "page_id long, url string, html string")
    rows = warc.archive(df, str(tmp_path / "w")).collect()
    assert [r.page_id for r in rows] == ids and all(len(r.captured_at) == len(rows[0].captured_at) for r in rows)
