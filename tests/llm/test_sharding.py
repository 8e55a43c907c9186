import random
import zlib

from slotatlas.llm import sharding


def test_rebalancing_evens_bytes_and_moves_little():
    rng = random.Random(2)
    size = [int(rng.expovariate(1 / 5000)) for _ in range(1024)]
    before = sharding.even_map(16, 1024)
    after = sharding.rebalance(before, size, 16)
    load = [sum(s for s, shard in zip(size, after) if shard == k) for k in range(16)]
    assert max(load) - min(load) <= max(1, 0.001 * sum(size) / 16)
    assert sum(a != b for a, b in zip(before, after)) < 512
    assert sharding.rebalance(after, size, 16) == after
    grown = sharding.rebalance(after, size, 17)
    load = [sum(s for s, shard in zip(size, grown) if shard == k) for k in range(17)]
    assert min(load) > 0.9 * max(load)
    assert sharding.rebalance(sharding.even_map(4, 8), [0] * 8, 4) == sharding.even_map(4, 8)


def test_versions_of_the_map_stay(spark, tmp_path):
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    assert store.latest() == 0
    first = store.store([0, 1, 0, 1], [5, 5, 5, 5])
    second = store.store([0, 1, 2, 1], [5, 5, 5, 5])
    assert (first, second) == (1, 2) and store.load(1) == [0, 1, 0, 1] and store.load(2) == [0, 1, 2, 1]


def test_places_are_gapless_and_sizes_exact(spark):
    texts = [(k % 40, "é" * (k % 7)) for k in range(300)] + [(None, None), (None, ""), (7, "long " * 10000)]
    df = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, shard int")
    records = sharding.measured(df, slots=64)
    size, rows = sharding.slot_totals(records, 64)
    out = sharding.place(records, sharding.rebalance(sharding.even_map(4, 64), size, 4), rows).collect()
    assert len(out) == len(texts) and sum(r["size"] for r in out) == sum(len((t or "").encode()) + 1 for _, t in texts)
    assert sorted(r.text_crc32 for r in out) == sorted(zlib.crc32((t or "").encode()) for _, t in texts)
    for shard in range(4):
        places = sorted(r.slot for r in out if r.shard == shard)
        assert places == list(range(len(places)))
    empty = sharding.measured(df.limit(0), slots=64)
    size, rows = sharding.slot_totals(empty, 64)
    assert sharding.place(empty, sharding.rebalance(sharding.even_map(4, 64), size, 4), rows).count() == 0
