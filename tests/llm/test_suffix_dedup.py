import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import queries
from ledgerline.llm import suffix_dedup as S
from ledgerline.llm._util import read


def brute(texts: list[bytes], length: int):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        starts, _ = S._runs(gone)
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), len(starts), hashlib.sha256(rest).hexdigest()))
    return out


def test_matching_statistics_against_brute_force():
    rng = random.Random(1)
    for case in range(60):
        strings = [bytes(rng.choice(b"ab" if case % 2 else b"abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        if case % 3 == 0:
            strings += [strings[0] + b"x" + strings[-1], strings[0]]
        best, starts, runs = S.matching_statistics(strings)
        assert 1 <= runs <= sum(map(len, strings)) + len(strings)
        spots = [(s, i) for s in range(len(strings)) for i in range(len(strings[s]))]
        for s, i in spots:
            longest = 0
            for s2, i2 in spots:
                if (s, i) != (s2, i2):
                    a, b, n = strings[s][i:], strings[s2][i2:], 0
                    while n < min(len(a), len(b)) and a[n] == b[n]:
                        n += 1
                    longest = max(longest, n)
            assert best[starts[s] + i] == longest, (strings, s, i)


def test_cells_partition_the_windows():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    first, last, at, g, c = S.cells(data, 30, 6)
    assert first[0] == 0 and last[-1] == 5000 - 30 and (first[1:] == last[:-1] + 1).all()
    assert ((at >= last) & (at + 6 <= first + 30)).all()
    twice = np.concatenate([data, data])
    f2, l2, *_ = S.cells(twice, 30, 6)
    assert set(zip(f2.tolist(), l2.tolist())) >= set(zip(first[1:-1].tolist(), last[1:-1].tolist()))


@pytest.mark.parametrize("options", [{}, {"group_cells": 2}, {"bucket_bytes": 600}])
def test_small_windows_against_brute_force(spark, options):
    rng = random.Random(7)
    phrases = [bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 90))) for _ in range(12)]
    texts = [b"".join(rng.choice(phrases) if rng.random() < 0.4 else bytes(rng.choice(b"abcdefg") for _ in range(rng.randint(1, 60)))
                      for _ in range(rng.randint(0, 12))) for _ in range(60)] + [b"a" * 300, b"ab" * 100]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])
           for r in S.remove_repeats(df, length=24, kmer=6, **options).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 24)


def test_whole_table_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"].encode()) for r in read(spark, "/root/testdata/sf0.01", "documents").collect())
    want = brute([t for _, t in docs], 200)
    rows = {r["doc_id"]: r for r in queries.op1_run_length_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert [(rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) for i, _ in docs] == want


def test_odd_rows(spark):
    a, b = "x".join(str(i) for i in range(100)), "é" * 150
    rows = [(1, None), (2, ""), (3, a), (3, a), (None, a[:199]), (None, b), (4, b), (5, "short")]
    df = spark.createDataFrame([(*r, 1, b"z") for r in rows], "doc_id long, text string, k long, spans binary")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(df).collect()), key=str)
    n = len(a)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, n, n), (3, n, n), (None, 199, 0), (None, 300, 300), (4, 300, 300), (5, 5, 0)], key=str)
    assert S.remove_repeats(df.limit(0)).collect() == []


def test_parts_of_a_bucket_divide_no_anchor(monkeypatch):
    from ledgerline.llm import suffix_dedup as S

    monkeypatch.setattr(S, "INDEX_BYTES", 100)
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        g = np.sort(rng.integers(-20, 20, n))
        sizes = rng.integers(1, 60, n)
        parts = S._whole_anchors(g, sizes)
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(n))
        assert all(g[a.stop - 1] != g[b.start] for a, b in zip(parts, parts[1:]))
        assert all(sizes[p].sum() >= 100 for p in parts[:-1])
    assert S._whole_anchors(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []
