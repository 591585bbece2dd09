"""Licenses outside the catalogue or close to another one are not reported as that one."""

import pytest

from swipewatch.llm import license
from swipewatch.llm.license import TEMPLATES, Templates


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the BSD License.", ["BSD/statement"]),
        ("Released under the Zlib License.", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0/short/statement"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0/statement"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0/statement"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0/statement"]),
        (TEMPLATES["GPL-3.0/notice"].replace("version 3", "version 2"), []),
        (TEMPLATES["GPL-3.0/notice"], ["GPL-3.0/notice"]),
        (TEMPLATES["MIT"], ["MIT"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0/statement"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0/statement"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", []),
        ("Licensed under the terms set out in our Apache License, Version 2.0.", ["Apache-2.0/statement"]),
        ("Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.", ["Apache-2.0/statement"] * 2),
    ],
)
def test_telling_words(text, want):
    assert [f[0] for f in Templates(license.TEMPLATES, 0.8).find(text.encode())] == want


def test_mit_reaches_its_end():
    assert TEMPLATES["MIT"].endswith("OTHER DEALINGS IN THE SOFTWARE.")


def test_common_words_are_not_aligned(monkeypatch):
    """Words that every text has vote for nearly every place; pieces without a template's other words are passed over."""
    calls, whole = [], license.aligned
    monkeypatch.setattr(license, "aligned", lambda a, b: calls.append(1) or whole(a, b))
    known = Templates(TEMPLATES, 0.8)
    common = "the of and to in any or a this with under is software by version 4 0 license " * 100
    assert known.find(common.encode()) == [] and not calls
    assert [f[0] for f in known.find(f"{common} {TEMPLATES['MIT']} {common}".encode())] == ["MIT"]
    # each beginning once, and only beginnings near the license
    assert len(calls) <= 2 * 5 * len(known.words["MIT"])
