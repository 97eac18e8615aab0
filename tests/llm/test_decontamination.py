import random

import numpy as np

from ledgerline.llm import decontamination as D
from ledgerline.llm import queries
from ledgerline.llm._util import read

rng = random.Random(11)


def words(n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edit(text, k):
    chars = list(text)
    for at in sorted(rng.sample(range(len(chars)), k), reverse=True):
        op = rng.randrange(3)
        if op == 0:
            chars[at] = "z"
        elif op == 1:
            del chars[at]
        else:
            chars.insert(at, "q")
    return "".join(chars)


def brute_distance(pattern, text):
    """Fewest edits of the pattern anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_align_against_brute_force():
    for _ in range(60):
        p = words(3)[:20]
        t = words(2) + edit(p, rng.randint(0, 5)) + words(2)
        got = D.align(np.frombuffer(p.encode(), np.uint8), np.frombuffer(t.encode(), np.uint8), 100)
        assert got[0] == brute_distance(p, t)
        assert brute_distance(t[got[1]:got[2]], p) <= got[0] or got[1] == got[2]


def test_search_is_the_brute_force_answer():
    items = [words(40), words(10), words(7), words(60)]
    block = [(i, o, s.tobytes()) for i, t in enumerate(items) for o, s in D.segments(D.normalise(t))]
    searcher = D.Searcher(block)
    for case in range(40):
        k = rng.randrange(4)
        piece = items[k] if case % 2 else items[k][:150]
        text = words(rng.randint(0, 30)) + " " + edit(piece, rng.randint(0, max(1, len(piece) // 9))) + " " + words(rng.randint(0, 30))
        flat = D.normalise(text).tobytes().decode()
        want = {b[0] for b in block if brute_distance(b[2].decode(), flat) <= D.budget(len(b[2]))}
        assert {m[0] for m in searcher.search(text)} == want, case


def test_verbatim_parts_at_any_place():
    local = random.Random(5)
    items = ["".join(local.choice("abcdefghijklmnop ") for _ in range(n)) for n in (394, 110, 81)]
    flat = [D.normalise(t) for t in items]
    searcher = D.Searcher([(i, o, s.tobytes()) for i, t in enumerate(flat) for o, s in D.segments(t)])
    for i, t in enumerate(flat):
        whole = t.tobytes().decode()
        for size in (D.VERBATIM, D.VERBATIM + 27):
            for at in range(len(whole) - size + 1):
                part = whole[at: at + size]
                if part == part.strip():
                    found = searcher.search(f"ZZ 77 {part} 88 ZZ " * 2)
                    assert [f[0] for f in found] == [i], (i, at, size)
    assert searcher.search(f"zz {flat[0].tobytes().decode()[63:63 + D.VERBATIM - 4]} zz") == []
    # neither two texts of one number nor two places of one text make up a run
    mixed = D.Searcher([(7, o, s.tobytes()) for t in (flat[0][:200], flat[0][150:]) for o, s in D.segments(t)])
    assert mixed.search(flat[0][70:130].tobytes().decode() + "x" + flat[0][300:350].tobytes().decode()) == []


def test_runs_over_block_ends(spark, monkeypatch):
    item = words(300)
    flat = D.normalise(item).tobytes().decode()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for size in (1, 120, 500):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        searchers = [D.Searcher(b) for b in D._blocks(bench, "item_id", "text")]
        assert len(searchers) > 2
        for at in range(0, len(flat) - D.VERBATIM + 1, 7):
            assert any(s.search("9 " + flat[at: at + D.VERBATIM].strip() + " 9") for s in searchers) or flat[at] == " " or \
                flat[at + D.VERBATIM - 1] == " ", (size, at)


def test_leaks_of_the_table(spark):
    docs = {r["doc_id"]: D.normalise(r["text"]).tobytes() for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    items = {r["item_id"]: D.normalise(r["text"]).tobytes() for r in read(spark, "/root/testdata/sf0.01", "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op3_decontamination(spark, "/root/testdata/sf0.01").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole and whole <= set(got) and all(got[k] == 0 for k in whole)
    for d, i in set(got) - whole:
        segs = [s.tobytes() for _, s in D.segments(np.frombuffer(items[i], np.uint8))]
        assert any(brute_distance(s, docs[d]) <= D.budget(len(s)) for s in segs)


def test_odd_rows(spark):
    item = words(30)
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (None, item, "x"), (4, "", "x"), (5, "short one", "x")],
                                  "item_id long, text string, doc_id string")
    rows = [(1, None), (1, item.upper()), (1, item.upper()), (None, "A " + item), (3, ""), (4, "short one"),
            (5, words(200_000) + " " + item.replace(" ", " -- ")), (6, "é")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, item_id long, edits long")
    got = [(r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 0), (None, 1, 0), (5, 1, 0)], key=str)
    assert {r["doc_id"] for r in D.clean(docs, bench).collect()} == {1, 3, 4, 6}
    assert D.find_leaks(docs.limit(0), bench).collect() == [] and D.find_leaks(docs, bench.limit(0)).collect() == []
