"""Licence notices and identifier tags in texts.

One Aho-Corasick automaton over the folded words of a text finds notice phrases and the words
of the tag ``SPDX-License-Identifier``.  What follows a tag is parsed by a shunting-yard parser
(``with`` binds before ``and``, ``and`` before ``or``) and evaluated: the result names the
licences, and whether a policy of allowed licences can be met.  ``with`` stands between one
licence and one exception.

Names of licences are identifiers that end in a version (and ``-only``, ``-or-later`` or a variant), such as
every versioned one of the public list, those of ``UNVERSIONED`` or of a list of one's own, and
``LicenseRef-...``, ``DocumentRef-...:LicenseRef-...``; ``+`` may follow.  Names of exceptions hold the word
exception, or are among ``EXCEPTIONS`` or ``AdditionRef-...``.  Punctuation and comment ends behind a name do not
belong to it.  Other names are unknown: they give no label and meet no policy, but the known names of their
expression count.

Nulls and empty texts have no words and no finds.  An expression ends before the first word that
can't go on with it; a tag without a valid expression, or with unknown names alone, gives no label.
Repeated rows each get their own result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import ALNUM_FOLD, text_bytes

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, each with the label that the method adds.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain dedication": "public-domain",
}
#: Identifiers of licences without a version, in lower case.
UNVERSIONED = frozenset(
    """
    0bsd aal abstyles adobe-glyph adsl afmparse aladdin amdplpa aml ampas antlr-pd apafml app-s2p bahyph barr beerware blessing
    bsd-protection bsd-source-code caldera checkmk clartistic crossword crystalstacker cube curl diffmark doc dotseqn dsdp dvipdfm
    egenix entessa eudatagrid eurosym fair freeimage fsfap fsful fsfullr ftl giftware gl2ps glide glulxe gnuplot hpnd htmltidy ibm-pibs icu ijg imagemagick
    imatix info-zip intel intel-acpi isc jasper json latex2e leptonica libpng libtiff linux-openib makeindex mirot mit mit-advertising mit-cmu mit-enna
    mit-feh mit-festival mit-modern-variant mitnfa motosoto mpich2 ms-lpl ms-pl ms-rl mtll mup naumen ncsa net-snmp netcdf newsletr ngpl nist-pd nlpl
    noweb nrl ntp ogtsl oml openssl parity pil plexus postgresql psfrag psutils qhull rdisc ruby saxpath scea sendmail sgp4 sissl sleepycat smlnj smppl snia
    ssh-openssh ssh-short swl tapr-ohl tcl tcp-wrappers tmate tosl unlicense vim vostrom w3c wsuipa wtfpl x11 xerox xinetd xnet xpp xskat
    zed zlib zlib-acknowledgement
    """.split()
)
#: Identifiers of exceptions that don't say so, in lower case.
EXCEPTIONS = frozenset("bootloader-exception gpl-cc-1.0 gstreamer-exception-2005 linux-syscall-note qwt-exception-1.0 u-boot-exception-2.0".split())
LONGEST = 100  # characters of a name
#: A name, a version and what may follow it: mit-0, mpl-2.0-no-copyleft-exception, cc-by-nc-sa-3.0-de, bsd-3-clause-clear, unicode-dfs-2016.
VERSIONED = re.compile(r"[a-z][a-z0-9_.]*(-[a-z0-9_.]+)*?-v?\d+(\.\d+)*[a-z]?(-[a-z0-9.]+)*|(python|unicode|bzip2)-\d[\d.]*")
REFERENCE = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
ADDITION = re.compile(r"(documentref-[a-z0-9.-]+:)?additionref-[a-z0-9.-]+")
TAG = "spdx license identifier"
ALLOWED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "zlib", "cc-by-4.0"})
RANK = {"or": 1, "and": 2, "with": 3}
TAG_IN_TEXT = re.compile(rb"spdx[-_ ]license[-_ ]identifier\s*:?[ \t]*([^\r\n]*)", re.I)
PART = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")


def is_exception(name: str) -> bool:
    return name in EXCEPTIONS or "exception" in name.split("-") or ADDITION.fullmatch(name) is not None


def is_license(name: str, own: frozenset = UNVERSIONED) -> bool:
    name = name.removesuffix("+")
    if len(name) > LONGEST:
        return False
    return name in own or REFERENCE.fullmatch(name) is not None or (VERSIONED.fullmatch(name) is not None and name not in EXCEPTIONS and (not is_exception(name) or "no" in name.split("-")))


def postfix(expression: str) -> list[str] | None:
    """The expression's operands and operators in postfix order, lower-cased; None if it is not valid or names no known licence.

    The longest leading run of well-formed tokens counts; comment ends and words after it are ignored.
    """
    out, stack, operand = [], [], True
    place, simple = 0, False  # simple: the last token was a licence, which an exception may follow
    while place < len(expression):
        if expression[place] in " \t":
            place += 1
            continue
        m = PART.match(expression, place)
        if not m:
            break
        part = m[0].lower().rstrip(".:-")  # an end of a sentence or comment
        excepted = bool(stack) and stack[-1] == "with" and operand
        if part == "(":
            if excepted:
                return None
            if not operand:
                break
            stack.append(part)
        elif part == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
            simple = False
        elif part in RANK:
            if operand or (part == "with" and not simple):
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[part]:
                out.append(stack.pop())
            stack.append(part)
            operand, simple = True, False
        else:
            if not operand:
                break
            if is_exception(part) != excepted and (excepted or not is_license(part)):
                return None
            out.append(part)
            operand, simple = False, not excepted
        place = m.start() + len(part)
    if operand or "(" in stack or not any(map(is_license, out)):
        return None
    return out + stack[::-1]


def evaluated(parts: list[str], allowed: frozenset = ALLOWED) -> tuple[list[str], bool]:
    """Licences named (an exception stays with its licence) and whether the allowed ones meet the expression."""
    # an exception comes behind its licence, then `with`
    names = {f"{p} with {parts[k + 1]}" if parts[k + 2 : k + 3] == ["with"] else p for k, p in enumerate(parts) if is_license(p)}
    stack: list[bool] = []
    for p in parts:
        if p not in RANK:
            stack.append(p.removesuffix("+") in allowed)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if p == "with" else left and right if p == "and" else left or right)
    return sorted(names), stack.pop()


def automaton(base: dict[str, str] = BASE, more: dict[str, str] = MORE) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in more.items():
        found.add_word(f" {phrase} ", (1, label, phrase))
    for phrase, label in base.items():
        found.add_word(f" {phrase} ", (0, label, phrase))
    found.add_word(f" {TAG} ", (2, "", TAG))
    found.make_automaton()
    return found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, allowed boolean"
)


def scanned(text: bytes, machine: ahocorasick.Automaton, allowed: frozenset = ALLOWED) -> tuple:
    """The columns of SCHEMA after doc_id for one text."""
    words = text.translate(ALNUM_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, labels, tags, others = [], set(), set(), 0, 0
    for end, (kind, label, phrase) in machine.iter(line):
        if kind == 0:
            places.append(end - len(phrase) - 1)
            base.add(label)
        elif kind == 1:
            labels.add(label)
            others += 1
        else:
            tags += 1
    expressions, fine = [], []
    if tags:
        for m in TAG_IN_TEXT.finditer(text):
            if parts := postfix(m[1].decode("utf-8", "ignore")):
                names, ok = evaluated(parts, allowed)
                labels.update(names)
                expressions.append(" ".join(parts))
                fine.append(ok)
    word = lambda at: line.count(" ", 0, at + 1) - 1
    score = 1.0 if expressions else 1.0 - 0.4 ** (len(places) + others)
    return (
        len(words),
        len(places),
        word(min(places)) if places else None,
        word(max(places)) if places else None,
        ",".join(sorted(base)),
        ",".join(sorted(base | labels)),
        score,
        expressions,
        all(fine) if fine else None,
    )


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = MORE, allowed: frozenset = ALLOWED) -> DataFrame:
    """For every row of docs (doc_id, text): words, places and labels of notices, parsed expressions, a score from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, more)
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
        for b in batches:
            rows = [scanned(t.as_py(), machine, allowed) for t in b.column("text")]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text")).mapInArrow(run, SCHEMA)
