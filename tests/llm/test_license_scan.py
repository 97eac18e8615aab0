import re

from ledgerline.llm import license_scan as L
from ledgerline.llm import queries
from ledgerline.llm._util import read

MIT = """/* The MIT License (MIT)
 * Copyright (c) 2020 Some One
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
 * LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
 * OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
 * SOFTWARE. */
int main() {}"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. x. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""


def test_whole_licences():
    assert L.apply_rules(L.identify(MIT)) == (["MIT"], [])
    assert L.apply_rules(L.identify(BSD)) == (["BSD-2-Clause"], [])
    more = BSD + ("\nNeither the name of the Foo Corp nor the names of its contributors may be used to endorse or promote products "
                  "derived\nfrom this software without specific prior written permission.")
    assert L.apply_rules(L.identify(more)) == (["BSD-3-Clause"], [])


def test_order_and_leftovers():
    found = ["gpl-see", "mit-brief", "apache2-brief", "x", "apache2-brief"]
    assert L.apply_rules(found) == (["MIT", "Apache-2.0", "Apache-2.0"], ["gpl-see", "x"])
    assert L.identify("We like the MIT license a lot. Not licensed under the MIT license today.") == []
    assert L.identify("foo bar\nLicensed under CC BY-NC 4.0.\nfoo. Released under the MIT License. foo") == ["cc-by-nc-4", "mit-brief"]


def test_triggers_cover_every_sentence():
    for _, sentence in L.SENTENCES:
        assert re.search(L.TRIGGERS, sentence), sentence
    names = {n for n, _ in L.SENTENCES}
    assert all(w in names for _, seq in L.RULES for w in seq)
    # wrapped text may break a trigger word pair, never a word
    assert all(re.search(L.TRIGGERS.replace("free software|public domain|", ""), s) for n, s in L.SENTENCES if n not in ("unlicense",))


def test_whole_table_against_plain_search(spark):
    docs = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    plain = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {i: {lic for s, lic in plain.items() if s in t} for i, t in docs.items()}
    got = {r["doc_id"]: set(r["licenses"]) for r in queries.op10_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: x for i, x in want.items() if x}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, MIT),
            (4, "words " * 100_000 + "\nlicensed under CC BY 4.0."), (5, "a licence"), (6, "see the GNU General Public License for more details.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, licenses string, unused int")
    got = [(r["doc_id"], r["licenses"], r["unused"]) for r in L.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(3, ["MIT"], []), (3, ["MIT"], []), (None, ["MIT"], []), (4, ["CC-BY-4.0"], []),
                                           (6, [], ["gpl-see"])], key=str)
    assert L.scan(df.limit(0)).collect() == []
