import random

import numpy as np
import pytest

from ledgerline.llm import _links, near_dedup, queries
from ledgerline.llm import near_dedup as N
from ledgerline.llm._util import read, save


def brute(texts: dict, width: int, percent: int = 80) -> dict:
    """id -> smallest id reachable, by comparing all pairs."""
    sets = {i: N.shingle_set(t, width) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {i: root(i) for i in ids}


def test_whole_table_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    want = brute(texts, 2)
    rows = queries.op4_minmax_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and len(set(want.values())) < len(texts)
    for r in rows:
        assert r["n_shingles"] == len(N.shingle_set(texts[r["doc_id"]], 2))
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def test_group_of_near_copies_around_the_threshold(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def variant(edits):
        words = list(base)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    texts = {i: variant(rng.randint(0, 12)) for i in range(150)}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=2).collect()}
    assert got == brute(texts, 2)


def test_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(50))
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, a), (7, a), (8, a.upper() + "\x0b"),
            (None, a), (None, None), (10, long), (11, long + " tail"), (12, "ONÉ"), (13, "oné")]
    df = spark.createDataFrame([(*r, 0, True, "s") for r in rows], "doc_id long, text string, n long, kept boolean, id string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True),
                          (7, 7, True), (8, 7, False), (None, None, True), (None, None, True), (10, 10, True), (11, 10, False),
                          (12, 12, True), (13, 13, True)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []
    left = near_dedup.drop_near_duplicates(df, width=2)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 6, 7, 10, 12, 13, None}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = np.unique(np.r_[shared, one]), np.unique(np.r_[shared, two])
    (keys, bits), (keys2, bits2) = N.signature(x), N.signature(y)
    assert 0.08 < (keys == keys2).mean() < 0.45    # 0.8 ** 7 = 0.21
    differ = sum(int(v).bit_count() for v in (bits ^ bits2).view(np.uint64))
    assert 18 < differ < 55 < N.FAR                # a tenth of 350 on average
    assert all((p == q).all() for p, q in zip(N.signature(x), N.signature(x)))


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)] + [(5000, 5000)]
    rng.shuffle(edges)
    df = save(spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long"), "t")
    got = {r["id"]: r["component"] for r in _links.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}
    assert _links.components(df.limit(0)).collect() == []


@pytest.mark.parametrize("text,width,size", [("a b a b", 2, 2), ("a", 2, 1), ("", 2, 0), ("a b c", 5, 1), (None, 2, 0)])
def test_shingle_sets(text, width, size):
    assert len(N.shingle_set(text, width)) == size == len(N.shingle_hashes(text, width))


def test_large_group_below_the_threshold_makes_few_pairs(spark):
    """Copies that differ from each other by more than the threshold allows share most
    buckets; linked are only some of them, and no pair of the group must be missed."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]

    def variant(words, edits):
        words = list(words)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"x{rng.randrange(10**6)}"
        return words

    texts = {0: " ".join(base)}
    for i in range(1, 260):
        texts[i] = " ".join(variant(base, rng.randint(9, 20)))
    for i in range(260, 300):                              # linked with one far copy, not with the centre
        texts[i] = " ".join(variant(texts[i - 100].split(), rng.randint(1, 9)))
    members, pairs = {}, []
    real = _links._remaining

    def counted(*args):
        out = save(real(*args), "counted")
        pairs.append(out.count())
        return out

    _links._remaining = counted
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(
            spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=2).collect()}
    finally:
        _links._remaining = real
    assert got == brute(texts, 2) and len(set(got.values())) > 50
    assert pairs and pairs[0] < 2_000                      # of 44,850


def test_self_similar_words_are_told_apart(spark):
    a = "a"
    for _ in range(10):                                    # a Thue-Morse word and its complement
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    text = f"{a} x {b} x {a}"
    assert len(N.shingle_hashes(text, 2)) == len(N.shingle_set(text, 2)) == 4
    texts = {1: f"{a} {a} {b}", 2: f"{b} {b} {a}", 3: f"{a}\n{a}  {b.upper()}", 4: f"{b} {a}"}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=2).collect()}
    want = brute({i: t for i, t in texts.items()}, 2)
    assert got == {i: (len(N.shingle_set(t, 2)), want[i]) for i, t in texts.items()}


def test_word_hashes_against_words():
    rng = random.Random(4)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 9))).encode() for _ in range(3000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashes = N.word_hashes(data, starts, ends)
    by = {}
    for w, h in zip(words, hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_equal_sets_in_another_order_are_linked(spark):
    one = " ".join(f"w{i}" for i in range(30))
    texts = {1: f"{one} {one} {one}", 2: f"{one} {one}", 3: f"{one}  {one}"}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
