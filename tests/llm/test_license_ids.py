"""Each template's text under its own identifier, and notices of licences that aren't listed."""

import random

import pytest
from tests_llm_helpers import prose
from test_rows import lcs

from wayfare.llm import licenses
from wayfare.llm.license_texts import TEMPLATES


def test_each_template_is_itself(make):
    texts = [(name, i, text) for name, all_ in TEMPLATES.items() for i, text in enumerate(all_)]
    rows = [(n, f"Some words before it. {text} And some after it.", None, None) for n, (_, _, text) in enumerate(texts)]
    got = {}
    for r in licenses.license_matches(make(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.template, r.coverage))
    assert got == {n: [(name, i, 1.0)] for n, (name, i, _) in enumerate(texts)}


LONG_GPL = TEMPLATES["GPL-3.0-or-later"][0]
APACHE = TEMPLATES["Apache-2.0"][1]


@pytest.mark.parametrize(
    "text",
    [
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the BSD License.",
        "Licensed under CC BY-NC 3.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        LONG_GPL.replace("version 3", "version 2"),
        LONG_GPL.replace("General", "Lesser General"),
        APACHE.replace("Version 2.0", "Version 1.1"),
    ],
)
def test_other_licenses_get_no_listed_name(make, text):
    assert licenses.license_matches(make([(1, f"Before it. {text} After it.", None, None)])).collect() == []


def test_changed_filler_still_matches(make):
    rows = [(1, "This book is licensed under the GNU General Public License, version 3.", None, None), (2, "Published under the MIT License.", None, None)]
    got = licenses.license_matches(make(rows)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "GPL-3.0-only"), (2, "MIT")]


def test_equal_matches_both_stay(make):
    twins = {"A": ("alpha beta gamma delta epsilon",), "B": ("alpha beta gamma delta epsilon",)}
    got = licenses.license_matches(make([(1, "so alpha beta gamma delta epsilon it is", None, None)]), twins).collect()
    assert sorted(r.license for r in got) == ["A", "B"]


def edited(words, rng, kind, share):
    """The words with one block, or scattered words, deleted, added or replaced."""
    words, n = list(words), max(1, int(share * len(words)))
    new = lambda: f"zz{rng.randrange(10**6)}"
    if kind.startswith("block"):
        at = rng.randrange(len(words) - n + 1)
        words[at : at + (0 if kind == "block added" else n)] = [] if kind == "block deleted" else [new() for _ in range(n)]
        return words
    for at in sorted(rng.sample(range(len(words)), n), reverse=True):
        words[at : at + (0 if kind == "added" else 1)] = [] if kind == "deleted" else [new()]
    return words


CHANGES = [("block deleted", 0.15), ("block deleted", 0.19), ("block added", 0.2), ("block added", 0.5), ("block added", 0.9), ("block replaced", 0.15), ("deleted", 0.1), ("added", 0.2), ("replaced", 0.1), ("replaced", 0.15)]


@pytest.mark.parametrize(("kind", "share"), CHANGES)
def test_edited_templates_are_found_wherever_plain_alignment_finds_them(make, kind, share):
    """Against the longest common subsequence of the whole edited text, which knows no fingerprints, chains or bands."""
    rng = random.Random(f"{kind} {share}")
    rows, want = [], {}
    for name, texts in TEMPLATES.items():
        for t, text in enumerate(texts):
            template = [w.lower() for w in licenses.WORD.findall(text)]
            for _ in range(4 if len(template) >= 40 else 0):
                words = edited(template, rng, kind, share)
                hashes = [licenses.word_hash(w) for w in words]
                matched = lcs(template, words)
                if matched >= licenses.COVERAGE * len(template) and licenses.identified(hashes, *licenses.identity(template)):
                    want[len(rows)] = (name, t, matched)
                rows.append((len(rows), f"{prose(len(rows), 40)} {' '.join(words)} {prose(1 + len(rows), 40)}", None, None))
    got = {}
    for r in licenses.license_matches(make(rows)).collect():
        got.setdefault(r.doc_id, {})[r.license, r.template] = r.matched_words
    # Fewer words beyond a block than make a fingerprint may stay unmatched.
    slack = licenses.GRAM + licenses.WINDOW - 2
    missed = {i: m for i, m in want.items() if got.get(i, {}).get(m[:2], 0) < m[2] - slack}
    assert len(want) >= 10
    # Scattered changes can leave no five words in a row.
    assert len(missed) <= (0 if kind.startswith("block") else 0.1 * len(want)), missed


def test_many_copies_of_a_notice_are_all_found(make):
    notice = TEMPLATES["Apache-2.0"][1]
    got = licenses.license_matches(make([(1, " ".join([notice] * 300), None, None)])).collect()
    assert len(got) == 300 and {r.coverage for r in got} == {1.0}
