import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import edit_embedding as ee
from ledgerline.llm import queries

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    """One step at a time, one text at a time."""
    coins = ee._coins().reshape(ee.WALKS, ee.CLASSES, ee.PERIOD)
    codes = [ord(c) for c in text]
    symbols = []
    for w in range(ee.WALKS):
        seen, i, step = [], 0, 0
        while i < len(codes):
            stay = int(coins[w, codes[i] % ee.CLASSES, step % ee.PERIOD])
            seen += [codes[i]] * stay
            step += stay
            i += 1
        for k in range(ee.SAMPLES):
            records = [int(r) for r in ee._records()[w, k] if r < len(seen)]
            symbols.append(seen[records[-1]] if seen else 0x110000)
    return ee._digits(np.array(symbols)).decode()


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sentence(rng, words):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(words))


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        if not chars:
            break
        at = rng.randrange(len(chars))
        rng.choice([lambda: chars.pop(at), lambda: chars.insert(at, "x"), lambda: chars.__setitem__(at, "q")])()
    return "".join(chars)


def test_fingerprints_against_single_steps(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "ab", "é😀", "a" * 700, *(sentence(rng, n) for n in (1, 5, 60, 200)), "tail\n" * 300]
    want = [brute_fingerprint(t) for t in texts]
    assert ee.fingerprint_texts(texts) == want
    monkeypatch.setattr(ee, "BLOCK", 64)                  # texts longer than a block, groups of few texts
    monkeypatch.setattr(ee, "GROUP_TEXTS", 3)
    monkeypatch.setattr(ee, "NARROW", 2)
    assert ee.fingerprint_texts(texts[::-1]) == want[::-1]
    assert ee.fingerprint_texts([]) == []
    assert len(want[0]) == ee.WALKS * ee.SAMPLES


def test_coins_and_samples():
    coins = ee._coins()
    assert coins.min() == 1 and 1.9 < coins.mean() < 2.1
    at = ee._samples(np.full(ee.WALKS, 1000))
    assert at.max() < 1000 and 400 < at.mean() < 600
    longer = ee._samples(np.full(ee.WALKS, 1100))
    assert 0.8 < (at == longer).mean() < 1                # consistent: 10/11 of the samples stay


def test_likeness_follows_edits():
    rng = random.Random(2)
    texts = [sentence(rng, 200) for _ in range(40)]
    prints = ee.fingerprint_texts(texts)
    few = ee.fingerprint_texts([edited(rng, t, 3) for t in texts])
    half = ee.fingerprint_texts([ee.half_replaced(t, o) for t, o in zip(texts, texts[1:] + texts[:1])])
    near = [ee.likeness(prints, p).mean() for p in (prints, few, half, prints[1:] + prints[:1])]
    assert near[0] == 1 and 0.8 < near[1] < 1 and 0.45 < near[2] < 0.7 and near[3] < 0.25


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("ab c", k=rng.randint(0, 20)))
        b = edited(rng, a, rng.randint(0, 6)) if a and rng.random() < 0.7 else "".join(rng.choices("ab c", k=rng.randint(0, 20)))
        d = brute_distance(a, b)
        for limit in (0, 1, 3, 40):
            assert ee.edit_distance(a, b, limit) == min(d, limit + 1)
    long = sentence(rng, 3000)
    assert 0 < ee.edit_distance(long, edited(rng, long, 30), 100) <= 30


def brute_next(rows):
    """(id, n_chars, edited sha256, fingerprint, its edited one) in the stated order, ids distinct."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (ident, text) in enumerate(ordered):
        text, other = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        made = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, b, c = (brute_fingerprint(t) for t in (text, made, other))
        share = [sum(x == y for x, y in zip(a, z)) / len(a) for z in (b, c)]
        out.append((ident, len(text), hashlib.sha256(made.encode()).hexdigest(), a, b, *share))
    return sorted(out)


def test_neighbours_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 3, sentence(rng, rng.randint(1, 30))) for i in range(60)] + [(1, None), (2, ""), (4, "é😀x"), (500, "y"), (-7, "odd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("next_text", F.lit("z"))
    got = ee.compare_with_next(df.repartition(5))
    assert sorted(map(tuple, got.collect())) == brute_next(rows)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_neighbours_of_odd_rows(spark):
    one = spark.createDataFrame([(5, "alone here")], "doc_id long, text string")
    row = ee.compare_with_next(one).first()
    assert row["near_next"] == 1 and row["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()
    assert ee.compare_with_next(one.limit(0)).collect() == []
    rows = [(None, "n1"), (None, None), (3, "same"), (3, "same"), (3, "other"), (2**60 + 1, "big")] + [(9, "hot")] * 50
    got = ee.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    assert {r["doc_id"] for r in got} == {None, 3, 9, 2**60 + 1}


def test_query_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_edit_fingerprints(spark, SF).collect()
    table = {r["doc_id"]: r for r in got}
    assert len(table) == len(got) == len(docs)
    ordered = sorted(docs, key=lambda r: -r["doc_id"])
    for k, row in enumerate(ordered):
        text, other = row["text"] or "", ordered[(k + 1) % len(ordered)]["text"] or ""
        mine = table[row["doc_id"]]
        made = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert (mine["n_chars"], mine["edited_sha256"]) == (len(text), hashlib.sha256(made.encode()).hexdigest())
    by_text = {}
    for row in docs:
        by_text.setdefault(row["text"] or "", set()).add(table[row["doc_id"]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.97


def test_near_documents(spark):
    rng = random.Random(5)
    base = [sentence(rng, rng.choice([30, 120, 400])) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(1000 + i, edited(rng, t, max(1, len(t) // 100))) for i, t in enumerate(base)]        # 1 % edits
    rows += [(2000, base[0]), (2001, base[0]), (3000, None), (3001, ""), (None, base[1]), (7, base[7])]
    df = spark.createDataFrame([(i, t, "g") for i, t in rows], "doc_id long, text string, group_id string")
    got = ee.near_documents(df.repartition(4))
    table = {(r["doc_id"], r["fingerprint"]): r for r in got.collect()}
    assert got.count() == len(rows)
    linked = sum(table[1000 + i, ee.fingerprint_texts([rows[60 + i][1]])[0]]["group_id"] == i for i in range(60))
    assert linked >= 58                                   # recall on planted copies, no pair wrongly joined
    for (ident, _), r in table.items():
        if ident is not None and ident < 60:
            assert r["group_id"] == ident and r["kept"]
    blank = ee.fingerprint_texts([""])[0]
    assert table[2000, ee.fingerprint_texts([base[0]])[0]]["group_id"] == 0
    assert table[3000, blank]["kept"] and table[3001, blank]["kept"]
    assert next(r for (i, _), r in table.items() if i is None)["group_id"] is None
    assert ee.near_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("a, b, limit", [("", "", 0), ("", "abc", 2), ("abc", "abc", 0), ("xabc", "abc", 1)])
def test_edit_distance_of_short_texts(a, b, limit):
    assert ee.edit_distance(a, b, limit) == min(brute_distance(a, b), limit + 1)
