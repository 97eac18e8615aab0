"""Every known sentence and rule against its notice as it is published."""

import re
import textwrap

import pytest

from ledgerline.llm import license_scan as L

GPL = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as "
       "published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
WARRANTY = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
GPL_SEE = "See the GNU General Public License for more details."
GPL_COPY = "You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."
APACHE = ("you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
          "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
          "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
          "express or implied. See the License for the specific language governing permissions and limitations under the License.")
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
       "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
       "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
       "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
       "included in all copies or substantial portions of the Software.")
MIT_END = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
           "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
           "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
           "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
       "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
       "following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
       "the following disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_END = ("3. Neither the name of Foo, Inc. nor the names of its contributors may be used to endorse or promote products derived from "
           "this software without specific prior written permission.")
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
       "that the above copyright notice and this permission notice appear in all copies.")

#: (notice, its licences, its sentences)
NOTICES = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); " + APACHE, ["Apache-2.0"],
     ["apache2-long", "apache2-use", "apache2-copy", "apache2-dist", "apache2-see"]),
    ("Licensed under the Apache License, Version 2.0; " + APACHE, ["Apache-2.0"],
     ["apache2-brief", "apache2-use", "apache2-copy", "apache2-dist", "apache2-see"]),
    ("Licensed under the Apache License, Version 2.0 (the \"License\").", ["Apache-2.0"], ["apache2-long"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], ["apache2-brief"]),
    ("The MIT License (MIT)\n\nCopyright (c) 2020 Foo\n\n" + MIT + "\n\n" + MIT_END, ["MIT"],
     ["mit-title", "mit-grant", "mit-notice", "as-is-caps", "no-liability"]),
    (MIT + "\n\n" + MIT_END, ["MIT"], ["mit-grant", "mit-notice", "as-is-caps", "no-liability"]),
    (MIT, ["MIT"], ["mit-grant", "mit-notice"]),
    ("Released under the MIT License.", ["MIT"], ["mit-brief"]),
    ("Licensed under the MIT License.", ["MIT"], ["mit-brief"]),
    ("This software is released under the MIT License.", ["MIT"], ["mit-brief"]),
    ("This project is licensed under the MIT License.", ["MIT"], ["mit-brief"]),
    ("The MIT License", ["MIT"], ["mit-title"]),
    ("MIT License", ["MIT"], ["mit-title"]),
    (BSD + "\n\n" + BSD_END, ["BSD-3-Clause"], ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]),
    (BSD, ["BSD-2-Clause"], ["bsd-redist", "bsd-source", "bsd-binary"]),
    ("Licensed under the 3-Clause BSD License.", ["BSD-3-Clause"], ["bsd3-brief"]),
    ("Licensed under the BSD License.", ["BSD"], ["bsd-brief"]),
    (f"{GPL.format(';', ';', 2)}\n\n{WARRANTY} {GPL_SEE}\n\n{GPL_COPY}", ["GPL-2.0-or-later"],
     ["gpl2-or-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    (f"{GPL.format(':', ',', 3)}\n\n{WARRANTY} {GPL_SEE}\n\n{GPL_COPY}", ["GPL-3.0-or-later"],
     ["gpl3-or-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    (GPL.format(";", ";", 2), ["GPL-2.0-or-later"], ["gpl2-or-later"]),
    (GPL.format(":", ",", 3), ["GPL-3.0-or-later"], ["gpl3-or-later"]),
    ("Licensed under the GNU General Public License, version 2.", ["GPL-2.0"], ["gpl2-brief"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], ["gpl3-brief"]),
    ("Licensed under the GNU General Public License, version 3.", ["GPL-3.0"], ["gpl3-brief"]),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"], ["lgpl21-brief"]),
    ("Licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"], ["lgpl3-brief"]),
    ("Licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"], ["agpl3-brief"]),
    (MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"],
     ["mpl2", "mpl2-copy"]),
    (MPL, ["MPL-2.0"], ["mpl2"]),
    (ISC, ["ISC"], ["isc-grant"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"], ["unlicense"]),
    ("To the extent possible under law, Foo Inc. has waived all copyright and related or neighboring rights to this work.", ["CC0-1.0"],
     ["cc0"]),
    *[(f"Licensed under CC {x} 4.0.", [f"CC-{x}-4.0"], [f"cc-{x.lower()}-4"]) for x in ("BY-NC", "BY-SA", "BY")],
    *[(f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License.", [f"CC-{x}-4.0"],
       [f"cc-{x.lower()}-4"]) for x, long in (("BY-NC", "-NonCommercial"), ("BY-SA", "-ShareAlike"), ("BY", ""))],
    ("Copyright (c) 2020 Foo Inc. All rights reserved.", [], ["all-rights"]),
]


def wrapped(notice, width, mark):
    lines = [x for part in notice.split("\n") for x in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""]]
    return "\n".join(mark + x for x in lines)


@pytest.mark.parametrize("width,mark", [(100_000, ""), (75, " * "), (70, "# "), (38, "// "), (20, "")])
def test_published_notices(width, mark):
    for notice, licences, sentences in NOTICES:
        text = "int x = 1;\n" + wrapped(notice, width, mark) + "\nint main() {}"
        found = L.identify(text)
        assert found == sentences, (notice, found)
        stated, rest = L.apply_rules(found)
        assert stated == licences and (not rest or not licences), notice
        assert re.search(L.TRIGGERS, text.lower()), notice


def test_all_entries_have_a_notice():
    assert {n for n, _ in L.SENTENCES} == {s for *_, found in NOTICES for s in found}
    assert {tuple(w) for _, w in L.RULES} <= {tuple(found) for *_, found in NOTICES}
    forms = {L.normalise(x) for notice, *_ in NOTICES for x in [notice]}
    assert {s for n, s in L.SENTENCES if n.endswith("-brief") or n.startswith("cc-")} <= forms | {"licensed under the apache license version 2 0"}


def test_wildcards_stop_at_known_sentences():
    assert L.identify("Copyright (c) 2020 Foo Inc. Licensed under the MIT License. All rights reserved.") == ["mit-brief"]
    assert L.identify("Copyright 2019 A.\nCopyright 2020 B. All rights reserved.") == ["all-rights"]
    assert L.identify("Copyright 2019 A. All rights reserved.\nCopyright 2020 B. All rights reserved.") == ["all-rights"] * 2
    assert L.identify("Copyright 2019 A. " + "Words and words. " * 60 + "All rights reserved.") == []
    assert L.identify(MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at\n"
                      "https://mozilla.org/MPL/2.0/.\n\nReleased under the MIT License.") == ["mpl2", "mpl2-copy", "mit-brief"]
