from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_permutation_and_inverse(n):
    p = sharding.permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, 5, inverse=True) == np.arange(n)).all()


def test_row_at_inverts_place():
    shard, slot = sharding.place(np.arange(1001), 1001, 24, 9)
    assert (sharding.row_at(shard, slot, 1001, 24, 9) == np.arange(1001)).all()
    assert max(Counter(shard.tolist()).values()) - min(Counter(shard.tolist()).values()) <= 1


def test_rows_law_and_reproducible(spark):
    def run():
        return {r["doc_id"]: r for r in queries.op9_feistel_shards(spark, "/root/testdata/sf0.01").collect()}

    a, b = run(), run()
    assert a == b and len(a) == 1000
    sizes = Counter(r["shard"] for r in a.values())
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in a.values() if r["shard"] == s) == list(range(sizes[s]))
    ids = sorted(a)
    shard, slot = sharding.place(np.arange(1000), 1000, 24, 2024)   # brute force: numbers by sorted id
    assert [(a[i]["shard"], a[i]["slot"]) for i in ids] == list(zip(shard.tolist(), slot.tolist()))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, "x")] * 40 + [(3, 1, None), (3, 1, None)], "doc_id long, c int, shard_name string")
    rows = sharding.shard_rows(df, ["doc_id", "c"], 5).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(42))
    assert len({(r["shard"], r["slot"]) for r in rows}) == 42
    assert sharding.shard_rows(df.limit(0), ["doc_id"], 5).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(df, ["doc_id"], 0)
