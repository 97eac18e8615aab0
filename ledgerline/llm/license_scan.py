"""Licence scan by sentence rules.

A text is split into fragments at line ends and after punctuation; fragments
and runs of them are normalised (lower case, comment marks and punctuation
dropped, one blank between words) and looked up among the known licence
sentences. Known sentences have punctuation inside ("free software; you can",
"v. 2.0"), so a run may go on behind any split, as long as a known sentence
begins with it. The longest run that is a known sentence counts. A sentence with
"*" takes the shortest run, of at most ``_longest`` characters, and none in
which another known sentence begins.
That gives a sequence of sentence identifiers. Rules are tried in their order;
each is a sequence of identifiers that must occur one after the other (other
fragments may lie between); what a rule matched is used up, and rules apply as
often as they match. The document's licences are the rules that matched, in
order of their place in the text; identifiers that no rule used are reported.

Only texts with one of the trigger words that every known sentence contains are
looked at in detail. Null and empty texts contain nothing. Repeated rows and
rows with a null id are each reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: licence sentences after normalisation, by identifier; "*" stands for any words in between
SENTENCES = [
    ("apache2-brief", "licensed under the apache license version 2 0"),
    ("apache2-long", "licensed under the apache license version 2 0 the license"),
    ("apache2-use", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-dist", "unless required by applicable law or agreed to in writing software distributed under the license is "
                     "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-brief", "released under the mit license"),
    ("mit-brief", "licensed under the mit license"),
    ("mit-brief", "this software is released under the mit license"),
    ("mit-brief", "this project is licensed under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "the mit license mit"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation the "
                  "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                  "persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
                   "of the software"),
    ("as-is-caps", "the software is provided as is without warranty of any kind express or implied including but not limited to "
                   "the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("no-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability "
                     "whether in an action of contract tort or otherwise arising from out of or in connection with the software "
                     "or the use or other dealings in the software"),
    ("bsd-redist", "redistribution and use in source and binary forms with or without modification are permitted provided that "
                   "the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the "
                   "following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived "
                    "from this software without specific prior written permission"),
    ("bsd-brief", "licensed under the bsd license"),
    ("bsd3-brief", "licensed under the 3 clause bsd license"),
    ("gpl3-brief", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-brief", "licensed under the gnu general public license version 3"),
    ("gpl2-brief", "licensed under the gnu general public license version 2"),
    ("gpl2-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                      "public license as published by the free software foundation either version 2 of the license or at your "
                      "option any later version"),
    ("gpl3-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                      "public license as published by the free software foundation either version 3 of the license or at your "
                      "option any later version"),
    ("gpl-no-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the "
                        "implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl21-brief", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl3-brief", "licensed under the gnu lesser general public license version 3"),
    ("agpl3-brief", "licensed under the gnu affero general public license version 3"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at *"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law * has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights", "copyright * all rights reserved"),
]

# fixed values: licence and the sequence of sentences that states it, most specific first
RULES = [
    ("Apache-2.0", ["apache2-long", "apache2-use", "apache2-copy", "apache2-dist", "apache2-see"]),
    ("Apache-2.0", ["apache2-brief", "apache2-use", "apache2-copy", "apache2-dist", "apache2-see"]),
    ("Apache-2.0", ["apache2-long"]),
    ("Apache-2.0", ["apache2-brief"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is-caps", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-caps", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-brief"]),
    ("MIT", ["mit-title"]),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-brief"]),
    ("BSD", ["bsd-brief"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0", ["gpl2-brief"]),
    ("GPL-3.0", ["gpl3-brief"]),
    ("LGPL-2.1", ["lgpl21-brief"]),
    ("LGPL-3.0", ["lgpl3-brief"]),
    ("AGPL-3.0", ["agpl3-brief"]),
    ("MPL-2.0", ["mpl2", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
]

#: every known sentence holds one of these
TRIGGERS = "licen|copyright|warrant|permission|distribut|free software|public domain|liab|unencumbered"
_WORDS = re.compile(r"[a-z0-9]+")

_exact: dict[str, str] = {s: i for i, s in SENTENCES if "*" not in s}
_open: list[tuple[re.Pattern, str]] = [
    (re.compile(re.escape(s).replace(r"\ \*\ ", " (?:.* )?").replace(r"\ \*", "(?: .*)?")), i) for i, s in SENTENCES if "*" in s]
_sorted = sorted(_exact)
_heads = [s.split(" *", 1)[0] for _, s in SENTENCES if "*" in s]
_starts = {s.split(" ", 1)[0] for _, s in SENTENCES}
_longest = max(len(s) for _, s in SENTENCES) + 200


def normalise(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def sentence_id(form: str) -> str | None:
    """Identifier of a normalised sentence."""
    found = _exact.get(form)
    if found is None and form.split(" ", 1)[0] in _starts:
        for pattern, name in _open:
            if pattern.fullmatch(form):
                return name
    return found


def may_go_on(form: str) -> bool:
    """Whether a known sentence begins with this run and another word."""
    more = f"{form} "
    at = bisect_left(_sorted, more)
    if at < len(_sorted) and _sorted[at].startswith(more):
        return True
    return len(form) <= _longest and any(more.startswith(f"{h} ") or h.startswith(more) for h in _heads)


def fragments(text: str) -> list[str]:
    """Normalised fragments."""
    forms = (normalise(piece) for line in text.split("\n") for piece in re.split(r"(?<=[.!?;:])\s+", line))
    return [form for form in forms if form]


def identify(text: str) -> list[str]:
    """Identifiers of the known sentences in order of the text."""
    parts = fragments(text)
    hits: list[tuple[str, int] | None] = [None] * len(parts)     # (identifier, fragments used) of what begins here
    for i in range(len(parts) - 1, -1, -1):
        form = parts[i]
        if form.split(" ", 1)[0] not in _starts:
            continue
        for n in range(1, len(parts) - i + 1):
            hit = sentence_id(form)
            if hit and form in _exact:
                hits[i] = hit, n
            elif hit:
                if not any(hits[i + 1: i + n]):
                    hits[i] = hit, n
                break
            if i + n == len(parts) or not may_go_on(form):
                break
            form = f"{form} {parts[i + n]}"
    out, i = [], 0
    while i < len(parts):
        if hits[i]:
            out.append(hits[i][0])
        i += hits[i][1] if hits[i] else 1
    return out


def apply_rules(found: list[str]) -> tuple[list[str], list[str]]:
    """(licences in order of place, identifiers that no rule used)."""
    used = [False] * len(found)
    stated: list[tuple[int, str]] = []
    for licence, wanted in RULES:
        while True:
            places, at = [], 0
            for w in wanted:
                while at < len(found) and (used[at] or found[at] != w):
                    at += 1
                if at == len(found):
                    break
                places.append(at)
                at += 1
            if len(places) < len(wanted):
                break
            for p in places:
                used[p] = True
            stated.append((places[0], licence))
    return [name for _, name in sorted(stated)], [f for f, u in zip(found, used) if not u]


def scan(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, licenses (distinct, in order of their place), sentences (known
    identifiers in order), unused; a row for every text with a known sentence."""

    @F.pandas_udf("licenses array<string>, sentences array<string>, unused array<string>")
    def look(text):
        import pandas as pd

        rows = []
        for t in text:
            found = identify(t)
            stated, rest = apply_rules(found)
            rows.append((list(dict.fromkeys(stated)), found, rest))
        return pd.DataFrame(rows, columns=["licenses", "sentences", "unused"])

    triggered = df.select(F.col(id_col), F.col(text_col).alias("_t")).where(F.lower("_t").rlike(TRIGGERS))
    return triggered.select(id_col, look("_t").alias("_r")).where(F.size("_r.sentences") > 0).select(id_col, "_r.*")
