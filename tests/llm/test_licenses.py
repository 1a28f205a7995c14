"""Notices and expressions."""

import re

import pytest

from strandline.llm import licenses
from strandline.llm.textops import ALNUM_WORD


@pytest.mark.parametrize(
    ("text", "names", "ok"),
    [
        ("MIT", ["mit"], True),
        ("GPL-2.0-only OR MIT", ["gpl-2.0-only", "mit"], True),
        ("GPL-2.0-only AND MIT", ["gpl-2.0-only", "mit"], False),
        ("MIT or (Apache-2.0 and GPL-3.0-only)", ["apache-2.0", "gpl-3.0-only", "mit"], True),
        ("MIT AND GPL-2.0+ WITH Classpath-exception-2.0 OR ISC", ["gpl-2.0+ with classpath-exception-2.0", "isc", "mit"], True),
        ("MIT */ trailing", ["mit"], True),
        ("MIT (see file)", ["mit"], True),
        ("MIT-->", ["mit"], True),
        ("Apache-2.0.", ["apache-2.0"], True),
        ("MIT: see file", ["mit"], True),
        ("GPL-2.0+.", ["gpl-2.0+"], False),
        ("(MIT OR ISC)-->", ["isc", "mit"], True),
        ("EUDatagrid", ["eudatagrid"], False),
        ("Zend-2.0 OR ZPL-2.1", ["zend-2.0", "zpl-2.1"], False),
        ("CC-BY-NC-SA-3.0-DE and MPL-2.0-no-copyleft-exception and BSD-3-Clause-Clear", ["bsd-3-clause-clear", "cc-by-nc-sa-3.0-de", "mpl-2.0-no-copyleft-exception"], False),
        ("MIT OR Foo", ["mit"], True),
        ("Foo AND MIT", ["mit"], False),
        ("GPL-2.0-only WITH Linux-syscall-note", ["gpl-2.0-only with linux-syscall-note"], False),
        ("GPL-3.0 with GCC-exception-3.1 or own-thing", ["gpl-3.0 with gcc-exception-3.1"], False),
        ("GPL-2.0 WITH llvm-exception AND GPL-2.0 OR LicenseRef-own.1", ["gpl-2.0", "gpl-2.0 with llvm-exception", "licenseref-own.1"], False),
    ],
)
def test_expressions(text, names, ok):
    assert licenses.evaluated(licenses.postfix(text)) == (names, ok)


WIDE = " with ".join(f"(a{k} or b{k})" for k in range(40))
GROUPS = " with ".join(["(MIT or ISC)"] * 40)


@pytest.mark.parametrize(
    "text",
    ["", "AND MIT", "MIT OR", "(MIT", "MIT OR )", "( )", "WITH", "see LICENSE file", "MIT with ISC", "MIT with (llvm-exception)", "MIT with llvm-exception with llvm-exception", "(MIT or ISC) with llvm-exception", "llvm-exception", "Foo", "Foo or Bar", "MIT with Foo", "...", "-->", WIDE, GROUPS],
)
def test_invalid_expressions(text):
    assert licenses.postfix(text) is None


TEXTS = [
    None, "", "Under the MIT License. And the mit-license", "GNU General\nPublic License; gnu general public general public license", "cc by cc BY-NC", "admit license",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\ncode", "SPDX-License-Identifier:", "mit licensé", "x " * 40000 + "Apache License", "ccby cc  by 4.0",
    "SPDX-License-Identifier: see LICENSE file", f"SPDX-License-Identifier: {WIDE}", f"SPDX-License-Identifier: {' and '.join(['MIT'] * 3000)}",
]


def test_places_equal_plain_search(spark):
    rows = [(k if k % 4 else None, t, 1) for k, t in enumerate(TEXTS)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int").coalesce(1)).collect()
    for r, (_, t, _) in zip(got, rows, strict=True):
        w = re.findall(ALNUM_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[6].labels == "apache-2.0,bsd-3-clause,mit" and got[6].allowed and got[6].score == 1.0
    assert [(got[k].labels, got[k].score) for k in (11, 12, 13)] == [("", 0.0), ("", 0.0), ("mit", 1.0)]
    assert got[7].labels == "" and got[4].labels == "cc-by,cc-by-nc"


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("end", "label"), [("MIT-->", "mit"), ("MIT -->", "mit"), ("Apache-2.0.", "apache-2.0"), ("MIT:", "mit"), ("ISC */", "isc"), ("0BSD#}", "0bsd"), ("MIT, see", "mit"), ("MIT;", "mit"), ('MIT"', "mit")])
def test_ends_of_tags(end, label):
    assert licenses.scanned(f"<!-- SPDX-License-Identifier: {end}".encode(), licenses.automaton())[5:7] == (label, 1.0)
