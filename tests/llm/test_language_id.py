import random
import zlib

import pytest

from ledgerline.llm import language_id as L
from ledgerline.llm import queries
from ledgerline.llm._util import read


GERMAN = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 != 2)


def brute_phrases(training: str, text: str) -> int:
    """Greedy longest-match phrases, blocks of BLOCK characters."""
    count = 0
    for s in range(0, len(text), L.BLOCK):
        block, i = text[s: s + L.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i: j + 1] in training and block[i:j] in training:
                j += 1
            i, count = j, count + 1
    return count


def test_phrases_match_brute_force():
    rng = random.Random(3)
    train = {"aa": "".join(rng.choice("abc ") for _ in range(300)), "bb": "".join(rng.choice("bcde") for _ in range(200))}
    parser = L.CrossParser(train)
    texts = ["".join(rng.choice("abcdez ") for _ in range(n)) for n in (1, 7, 50, 3000)]
    got = parser.phrases([L.normalise(t) for t in texts])
    flat = lambda t: "".join(map(chr, L.normalise(t)))
    for k, lang in enumerate(parser.languages):
        indexed = flat(train[lang])
        assert got[k].tolist() == [brute_phrases(indexed, flat(t)) for t in texts]


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_learns_only_from_allowed_rows(spark):
    rows = [(i, f"text number {i}", "en" if i % 2 else None) for i in range(200)]
    got = L.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    used = {int(x.split()[-1]) for x in got["en"].replace("text", "\ntext").split("\n") if x.strip()}
    assert used and all(i % 2 and zlib.crc32(str(i).encode()) % 4 != 2 for i in used) and set(got) == {"en"}


def test_every_picked_document_is_learned_from(spark):
    words = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(400)]     # document i repeats word i
    rows = [(i, f"{w} -- " * (30_000 if i % 7 == 0 else 3 if i % 7 == 1 else 500), "en") for i, w in enumerate(words)]
    text = L.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]
    flat = "".join(map(chr, L.normalise(text)))
    assert 0.99 * L.TRAIN_CHARS < len(flat) <= L.TRAIN_CHARS and len(text) <= L.TRAIN_CHARS
    used = {w: flat.count(f"{w} ") for w in words if f"{w} " in flat}
    assert len(used) > 0.8 * L.TRAIN_DOCUMENTS and max(used.values()) < 2000


def test_equal_cut():
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.randrange(60) for _ in range(rng.randint(1, 8))]
        total = rng.randrange(300)
        fits = [c for c in range(max(lengths) + 1) if sum(min(n, c) + 1 for n in lengths) <= total]
        assert L.equal_cut(lengths, total) == (max(fits) if fits else 0), (lengths, total)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, held_out string"
    rows = [(1, "the cat and the dog", "en", "x", "y"), (1, "the cat and the dog", "en", "x", "y"), (3, None, "en", None, None),
            (None, "der hund und die katze", "de", None, None), (5, "", None, None, None), (6, "12 !?", None, None, None),
            (7, "the dog " * 50_000, None, None, None), (8, "日本語", None, None, None),
            (GERMAN, "der hund und die katze", "de", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [(r["doc_id"], r["lang_pred"]) for r in L.identify(df).collect()]
    assert (8, "en") in got or (8, "de") in got      # no known letter: a tie of phrases, the shorter index wins
    got = [g for g in got if g[0] != 8]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (3, "und"), (None, "de"), (5, "und"), (6, "und"), (7, "en"), (GERMAN, "de")], key=str)
    assert L.identify(df.limit(0)).collect() == []
    assert [r["lang_pred"] for r in L.identify(df.where("doc_id = 1"), {}).collect()] == ["und", "und"]


def test_normalise():
    assert "".join(map(chr, L.normalise("Ab1-Cé \n d!"))) == "ab cé d "
    assert len(L.normalise(None)) == 0 and len(L.normalise("123")) == 0
    assert pytest.approx(1.0) == L.CrossParser({"a": "abc"}).predict(["abc"])[1][0]
