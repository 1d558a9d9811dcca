"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser
evaluates the tags' and/or/with expressions.

Texts: null counts as empty. Empty texts give no places, empty labels and score 0. Repeated rows give repeated
results; other columns of the input are not read.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache
from itertools import zip_longest

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The phrases whose words, standing consecutively, are the base of the scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, in the same word form.
NOTICES = {
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "isc license": "isc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx-license-identifier:"
#: Families of the public licence-id list, lower-cased. An id is of the longest family that it begins with.
FAMILIES = (
    "aal abstyles adobe adsl afl agpl aladdin amdplpa aml ampas antlr apache apafml apl apsl artistic bahyph barr beerware bitstream "
    "bittorrent blessing blueoak borceux bsd bsl busl bzip2 c-uda cal caldera catosl cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd "
    "cc-by-sa cc-pddc cc0 cddl cdla cecill cern-ohl clartistic cnri condor cpal cpl cpol crossword cua-opl cube curl d-fsl diffmark doc "
    "dotseqn drl dsdp dvipdfm ecl efl egenix elastic entessa epics epl erlpl etalab eudatagrid eupl eurosym fair frameworx freeimage "
    "fsfap fsful fsfullr ftl gfdl giftware gl2ps glide glulxe glwtpl gnuplot gpl gsoap haskellreport hippocratic hpnd icu ijg imagemagick "
    "imatix imlib2 info-zip intel interbase ipa ipl isc jasper jpnic json lal latex2e leptonica lgpl lgpllr libpng libselinux libtiff "
    "liliq linux-openib lpl lppl makeindex miros mirros mit motosoto mpich2 mpl ms-pl ms-rl mtll mulanpsl multics mup naist nasa naumen "
    "nbpl ncsa net-snmp netcdf newsletr ngpl nlod nlpl nokia nosl noweb npl nposl nrl ntp o-uda oclc odbl odc-by ofl ogc ogl-uk ogtsl oldap "
    "oml openssl opl oset osl parity pddl php plexus postgresql psf psfrag psutils python qhull qpl rdisc rhecos rpl rpsl rsa-md rscpl "
    "ruby sax-pd saxpath scea sgi-b shl simpl sissl sleepycat smlnj smppl snia spencer spl sspl sugarcrm swl tapr-ohl tcl tcp-wrappers "
    "tmate torque tosl ucl unicode unlicense upl vim vostrom vsl w3c watcom wsuipa wtfpl x11 xerox xfree86 xinetd xnet xpp xskat ypl "
    "zed zend zimbra zlib zpl"
).split()
#: Families whose label is another's.
ALIASES = {"0bsd": "bsd", "gplv": "gpl", "lgplv": "lgpl", "apachev": "apache"}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc0", "cc-by", "afl", "artistic", "blueoak", "bsl", "bzip2", "curl", "ecl", "fsfap", "hpnd", "icu", "ijg", "libpng", "libtiff", "ncsa", "ntp", "openssl", "php", "postgresql", "psf", "python", "ruby", "unicode", "unlicense", "upl", "w3c", "wtfpl", "x11", "zlib", "zpl"}

_LOWER = {c: c + 32 for c in range(65, 91)}
_GAPS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")
_RANK = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, permissive boolean"


@cache
def _families() -> dict[str, str]:
    return {f: f for f in FAMILIES} | ALIASES


@lru_cache(65_536)
def label_of(licence: str) -> str | None:
    """The label of a licence id: its longest known family, which ends there or goes on with a version or variant. Words of prose have none."""
    name, known = licence.lower(), _families()
    if len(name) > 64:
        return None  # no id is so long
    return next((known[name[:n]] for n in range(len(name), 0, -1) if name[:n] in known and re.fullmatch(r"[-+.]?v?\d.*|[-+].*|", name[n:])), None)


def postfix(expression: str, at: int = 0, end: int | None = None) -> list[str]:
    """Shunting yard: the expression between two places in reverse Polish order. Stops at the first token that cannot continue it, as a tag's line goes on with other text."""
    out: list[str] = []
    stack: list[str] = []
    want_operand, end = True, len(expression) if end is None else end
    while m := _TOKEN.match(expression, at, end):
        token, low = m[1], m[1].lower()
        if want_operand and token == "(":
            stack.append(token)
        elif want_operand and token != ")" and low not in _RANK:
            out.append(token)
            want_operand = False
        elif not want_operand and token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        elif not want_operand and low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            want_operand = True
        else:
            break
        at = m.end()
    if want_operand and stack and stack[-1] in _RANK:
        stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(expression: str, at: int = 0, end: int | None = None) -> tuple[set[str], bool] | None:
    """Labels of a licence expression and whether its terms can be met by permissive licences alone; None without a known licence. An unknown id in it has no label and is not permissive."""
    values: list[tuple[set[str], bool]] = []
    for token in postfix(expression, at, end):
        if token in _RANK and len(values) >= 2:
            right, left = values.pop(), values.pop()
            if token == "with":
                values.append(left)
            else:
                left[0].update(right[0])
                values.append((left[0], (left[1] or right[1]) if token == "or" else (left[1] and right[1])))
        elif token not in _RANK:
            label = label_of(token)
            values.append(({label} if label else set(), label in PERMISSIVE))
    return values[-1] if values and values[-1][0] else None


@cache
def _automaton() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """One over words parted and edged by single blanks, one over the lower-cased text itself for tags."""
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        words.add_word(f" {phrase} ", (phrase, label))
    tags.add_word(TAG, TAG)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(text: str | None) -> tuple:
    words, tags = _automaton()
    lowered = (text or "").translate(_LOWER)
    spaced = f" {_GAPS.sub(' ', lowered).strip(' ')} "
    n_words = spaced.count(" ") - 1 if len(spaced) > 2 else 0
    places: set[int] = set()
    base: set[str] = set()
    labels: set[str] = set()
    n_base, at, before = 0, 0, 0
    found = sorted((end - len(phrase) - 1, phrase, label) for end, (phrase, label) in words.iter(spaced)) if n_words else []
    for begin, phrase, label in found:
        before += spaced.count(" ", at, begin)
        at = begin
        labels.add(label)
        if phrase in BASE:
            n_base += 1
            places.add(before)
            base.add(label)
    n_tags, verdicts, line_end = 0, [], -1
    ends = [end for end, _ in tags.iter(lowered)]
    for end, following in zip_longest(ends, ends[1:]):
        if line_end <= end:
            line_end = lowered.find("\n", end + 1)
            line_end = len(lowered) if line_end < 0 else line_end
        # An expression ends where the next tag begins, so no text is parsed twice.
        if value := evaluate(lowered, end + 1, line_end if following is None else min(line_end, following - len(TAG) + 1)):
            n_tags += 1
            labels |= value[0]
            verdicts.append(value[1])
    score = 0.0 if not labels else 1.0 if n_tags else 0.9 if base else 0.6
    permissive = None if not labels else all(verdicts) if verdicts else labels <= PERMISSIVE
    return n_words, n_base, min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, n_tags, permissive


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base places and labels, all labels, a confidence and the tags' verdict."""

    def work(part: pa.Table) -> dict[str, list]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows = [(i, *scan(t)) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, work)
