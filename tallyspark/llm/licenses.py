"""License scans by ordered signature rules.

Each rule is a regular expression for one way to name, link or quote one license. An automaton
of keywords runs over every text first; only rules with a keyword that occurs are tried. Detections
that overlap are resolved by priority, then by interval containment: the more telling rule
wins, and a detection inside a longer one of the same rank goes.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, replace

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.llm.common import strings

# The base phrases and their labels.
BASE = {
    ("cc", "by"): "cc-by",
    ("general", "public", "license"): "gpl",
    ("all", "rights", "reserved"): "reserved",
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# License families as (label, SPDX identifiers, a pattern of the name, keywords of the name, a link or "").
# Every text that a pattern matches holds one of its keywords; several are parted by a bar.
FAMILIES = (
    ("apache-1.1", "Apache-1.1", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1", "apache", ""),
    ("apache-2.0", "Apache-2.0", r"apache (?:software )?licen[sc]e,? \(?(?:version |v\.? ?)?2(?:\.0)?\b\)?", "apache", r"apache\.org/licenses/license-2\.0"),
    ("apache", "", r"apache (?:software )?licen[sc]e", "apache", ""),
    ("mit", "MIT|MIT-0", r"(?:the )?mit(?:/x11|/expat)? licen[sc]e", "mit", r"opensource\.org/licenses?/mit"),
    ("x11", "X11", r"x11 licen[sc]e", "x11", ""),
    ("bsd-2-clause", "BSD-2-Clause", r"(?:simplified bsd|freebsd|bsd[ -]2[ -]clause|2[ -]clause bsd) licen[sc]e", "bsd", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "BSD-3-Clause", r"(?:(?:new|modified|revised) bsd|bsd[ -]3[ -]clause|3[ -]clause bsd) licen[sc]e", "bsd", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "BSD-4-Clause", r"(?:original bsd|bsd[ -]4[ -]clause|4[ -]clause bsd) licen[sc]e", "bsd", ""),
    ("bsd", "0BSD", r"bsd(?:-style)? licen[sc]e", "bsd", ""),
    ("isc", "ISC", r"isc licen[sc]e", "isc", r"opensource\.org/licenses?/isc"),
    ("gpl-1.0", "GPL-1.0|GPL-1.0-only|GPL-1.0-or-later", r"gnu (?:general public licen[sc]e|gpl),?(?: ?(?:version |v\.? ?)|[ ]?)1(?:\.0)?\b", "gnu", ""),
    ("gpl-2.0", "GPL-2.0|GPL-2.0-only|GPL-2.0-or-later", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v\.? ?)2(?:\.0)?\b", "gpl|general public licen", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "GPL-3.0|GPL-3.0-only|GPL-3.0-or-later", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v\.? ?)3(?:\.0)?\b", "gpl|general public licen", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1", "LGPL-2.1|LGPL-2.1-only|LGPL-2.1-or-later", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v\.? ?)2\.1", "gpl|general public licen", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "LGPL-3.0|LGPL-3.0-only|LGPL-3.0-or-later", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v\.? ?)3(?:\.0)?\b", "gpl|general public licen", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "LGPL-2.0-only", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "public licen", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", "AGPL-3.0|AGPL-3.0-only|AGPL-3.0-or-later", r"(?:gnu )?(?:affero general public licen[sc]e|agpl),? ?(?:version |v\.? ?)3(?:\.0)?\b", "gpl|general public licen", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", "", r"(?:gnu )?(?:affero general public licen[sc]e|agpl\b)", "gpl|general public licen", ""),
    ("gfdl", "GFDL-1.2-only|GFDL-1.3-only", r"gnu free documentation licen[sc]e", "documentation", r"gnu\.org/licenses/fdl"),
    ("mpl-1.1", "MPL-1.1", r"mozilla public licen[sc]e,? ?(?:version |v\.? ?)?1\.1", "mozilla", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "MPL-2.0", r"mozilla public licen[sc]e,? ?(?:version |v\.? ?)?2\.0", "mozilla", r"mozilla\.org/mpl/2\.0"),
    ("mpl", "", r"mozilla public licen[sc]e", "mozilla", ""),
    ("epl-1.0", "EPL-1.0", r"eclipse public licen[sc]e,? ?(?:-|version |v\.? ?)?1\.0", "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "EPL-2.0", r"eclipse public licen[sc]e,? ?(?:-|version |v\.? ?)?2\.0", "eclipse", r"eclipse\.org/legal/epl-2\.0"),
    ("epl", "", r"eclipse public licen[sc]e", "eclipse", ""),
    ("cddl", "CDDL-1.0|CDDL-1.1", r"common development and distribution licen[sc]e", "distribution licen", ""),
    ("cpl", "CPL-1.0", r"common public licen[sc]e", "common public", ""),
    ("ecl", "ECL-2.0", r"educational community licen[sc]e", "educational", ""),
    ("eupl", "EUPL-1.1|EUPL-1.2", r"european union public licen[sc]e", "european", ""),
    ("artistic", "Artistic-1.0|Artistic-2.0", r"artistic licen[sc]e", "artistic", r"opensource\.org/licenses?/artistic"),
    ("zlib", "Zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", ""),
    ("bsl", "BSL-1.0", r"boost software licen[sc]e", "boost", r"boost\.org/license_1_0"),
    ("busl", "BUSL-1.1", r"business source licen[sc]e", "business source", ""),
    ("sspl", "SSPL-1.0", r"server side public licen[sc]e", "server side", ""),
    ("elastic", "Elastic-2.0", r"elastic licen[sc]e", "elastic", ""),
    ("unlicense", "Unlicense", r"(?:released|licen[sc]ed) under the unlicen[sc]e", "unlicen", r"unlicense\.org"),
    ("wtfpl", "WTFPL", r"do what the f\S{1,4} you want to public licen[sc]e", "public licen", ""),
    ("psf", "PSF-2.0|Python-2.0", r"python software foundation licen[sc]e", "python", ""),
    ("php", "PHP-3.0|PHP-3.01", r"php licen[sc]e", "php", ""),
    ("ruby", "Ruby", r"ruby licen[sc]e", "ruby", ""),
    ("openssl", "OpenSSL", r"openssl licen[sc]e", "openssl", ""),
    ("ofl", "OFL-1.1", r"(?:sil )?open font licen[sc]e", "open font", r"scripts\.sil\.org/ofl"),
    ("odbl", "ODbL-1.0", r"open data(?:base| commons open database) licen[sc]e", "open data", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "ODC-By-1.0", r"open data commons attribution licen[sc]e", "open data", r"opendatacommons\.org/licenses/by"),
    ("pddl", "PDDL-1.0", r"public domain dedication and licen[sc]e", "public domain", ""),
    ("ms-pl", "MS-PL", r"microsoft public licen[sc]e", "microsoft", ""),
    ("ms-rl", "MS-RL", r"microsoft reciprocal licen[sc]e", "microsoft", ""),
    ("cc0", "CC0-1.0", r"\bcc0(?:[ -]1\.0)?\b", "cc0", r"creativecommons\.org/publicdomain/zero"),
    ("w3c", "W3C", r"w3c software (?:notice and )?licen[sc]e", "w3c", ""),
    ("osl", "OSL-3.0", r"open software licen[sc]e", "open software", ""),
    ("afl", "AFL-3.0", r"academic free licen[sc]e", "academic", ""),
    ("cecill", "CECILL-2.0|CECILL-2.1|CECILL-B|CECILL-C", r"cecill(?:-[bc])? (?:free software )?licen[sc]e", "cecill", ""),
    ("bouncy-castle", "", r"bouncy castle licen[sc]e", "bouncy", ""),
    ("ncsa", "NCSA", r"university of illinois/ncsa open source licen[sc]e", "ncsa", ""),
    ("vim", "Vim", r"vim licen[sc]e", "vim", ""),
    ("tex", "LPPL-1.3c", r"latex project public licen[sc]e", "latex", ""),
    ("openrail", "", r"(?:creativeml |bigscience )?open ?rail(?:-?[dm]+)? licen[sc]e", "rail", ""),
    ("llama", "", r"llama (?:\d )?community licen[sc]e", "llama", ""),
)
# Creative Commons elements, each with versions 1.0 to 4.0.
CC_ELEMENTS = {"by": "attribution", "by-sa": "attribution[- ]sharealike", "by-nd": "attribution[- ]noderivs", "by-nc": "attribution[- ]noncommercial", "by-nc-sa": "attribution[- ]noncommercial[- ]sharealike", "by-nc-nd": "attribution[- ]noncommercial[- ]noderivs"}
# Texts and notices that need no license name, as (label, keyword, pattern, priority).
NOTICES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 4),
    ("isc", "permission to use", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee", 4),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification", 4),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e", 4),
    ("gpl", "free software", r"(?:this program is )?free software[:;,] you can redistribute it and/or modify", 4),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software", 4),
    ("zlib", "as-is", r"provided 'as-is',? without any express or implied warranty", 3),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 2),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 1),
    ("copyright", "©", r"© ?(?:19|20)\d\d", 1),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 2),
    ("no-redistribution", "redistribut", r"(?:do not|may not be) (?:copied or )?redistributed?", 2),
    ("no-ai-training", "train", r"may not be used (?:to train|for training)", 2),
    ("permission-required", "permission", r"without (?:the )?(?:prior )?(?:written )?permission of the (?:author|publisher|owner)", 2),
    ("reserved", "reserved", r"(?:some|no) rights reserved", 1),
    ("cc", "creative commons", r"creative commons", 1),
)
#: Ranks of the ways to name a license: identifier line, link, grant, bare name.
PRIORITY = {"spdx": 6, "link": 5, "grant": 4, "name": 3}
_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|made available|covered) (?:by|under|with)(?: the terms of)?(?: the| an?)? "


# A blank of a rule stands for blanks within a line, or for one line break with indents and comment marks. Never
# for an empty line, so numbers of a list below a name are not taken for its version.
_MARKS = r"[^\S\n]{0,40}(?:[*#;%]{1,4}|//+|--)?[^\S\n]{0,40}"
GAP = rf"(?:[^\S\n]{{1,40}}(?:\n{_MARKS})?|\n{_MARKS})"
_GAP = re.compile(GAP)


def wrapped(pattern: str) -> str:
    """``pattern`` with a gap for each blank; a blank alone in brackets stays a blank."""
    parts = pattern.replace("[ -]", "(?: |-)").replace("[- ]", "(?: |-)").split("[ ]")
    return "[ ]".join(part.replace(" ", GAP) for part in parts)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: str
    pattern: str
    priority: int


def in_expression(identifier: str) -> str:
    """An identifier anywhere in the expression of an identifier line, as in ``(MIT OR Apache-2.0)``.

    The group ``at`` is the identifier itself, so that those of one line don't contain each other.
    """
    before = r"(?:[()\w.+-]+[^\S\n]+(?:and|or|with)[^\S\n]+)*\(*"
    return rf"spdx-license-identifier:[^\S\n]*{before}(?P<at>{re.escape(identifier.lower())})(?![\w.-])"


def rules() -> list[Rule]:
    """All rules, in order; several hundred, made from the families."""
    out = []
    for label, spdx, name, keyword, link in FAMILIES:
        for identifier in filter(None, spdx.split("|")):
            out.append(Rule(label, "spdx-license-identifier", in_expression(identifier), PRIORITY["spdx"]))
        if link:
            out.append(Rule(label, link.split("/")[0].replace("\\", ""), link, PRIORITY["link"]))
        out.append(Rule(label, keyword, _GRANT + rf"(?:{name})", PRIORITY["grant"]))
        out.append(Rule(label, keyword, rf"\b(?:{name})", PRIORITY["name"]))
    for element, words in CC_ELEMENTS.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v, label = re.escape(version), f"cc-{element}-{version}"
            out.append(Rule(label, "spdx-license-identifier", in_expression(f"cc-{element}-{version}"), PRIORITY["spdx"]))
            out.append(Rule(label, "creativecommons.org", rf"creativecommons\.org/licenses/{element}/{v}", PRIORITY["link"]))
            out.append(Rule(label, "cc", _GRANT + rf"cc[ -]{element}[ -]{v}", PRIORITY["grant"]))
            out.append(Rule(label, "cc", rf"\bcc[ -]{element}[ -]{v}", PRIORITY["name"]))
            out.append(Rule(label, "creative commons", rf"creative commons {words}(?: licen[sc]e)?,? (?:version )?{v}", PRIORITY["name"]))
        out.append(Rule(f"cc-{element}", "cc", rf"\bcc[ -]{element}(?![ -](?:sa|nd|nc)\b)", PRIORITY["name"] - 1))
    out += [Rule(label, keyword, pattern, priority) for label, keyword, pattern, priority in NOTICES]
    return [replace(rule, pattern=wrapped(rule.pattern)) for rule in out]


class Scanner:
    """Keyword automaton and rules, built once for each task. A pattern is compiled when first tried."""

    def __init__(self):
        self.rules = rules()
        self.compiled: dict[int, re.Pattern] = {}
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for keyword in rule.keywords.split("|"):
                by_keyword.setdefault(keyword, []).append(i)
        self.gate = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self.gate.add_word(keyword, (keyword, numbers))
        for phrase in BASE:
            if not self.gate.exists(phrase[0]):
                self.gate.add_word(phrase[0], (phrase[0], []))
        self.gate.make_automaton()

    def keywords(self, low: str) -> dict[str, list[int]]:
        """The keywords of a text, with their rules; gaps count as one blank, as in the patterns."""
        return {keyword: numbers for _, (keyword, numbers) in self.gate.iter(_GAP.sub(" ", low))}

    def detections(self, low: str, found: dict[str, list[int]] | None = None) -> list[tuple[int, int, str, int]]:
        """(start, end, label, priority) of the detections left after suppression, by start."""
        found = self.keywords(low) if found is None else found
        raw = []
        for i in sorted({i for numbers in found.values() for i in numbers}):
            rule = self.rules[i]
            pattern = self.compiled.get(i) or self.compiled.setdefault(i, re.compile(rule.pattern))
            part = "at" if pattern.groupindex else 0
            raw += [(*m.span(part), rule.label, rule.priority, i) for m in pattern.finditer(low)]
        return suppress(raw)


def suppress(raw: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int]]:
    """Resolve overlaps. In order of priority, then length, then rule order, a detection is kept
    unless one kept before contains it or overlaps it; so of nested intervals of one rank the
    longer stays. What is kept never overlaps, so one sorted list of ends settles each case."""
    kept: list[tuple[int, int, str, int]] = []
    for start, end, label, priority, _ in sorted(raw, key=lambda d: (-d[3], d[0] - d[1], d[4], d[0])):
        at = bisect_right(kept, (start, float("inf")))
        if (at and kept[at - 1][1] > start) or (at < len(kept) and kept[at][0] < end):
            continue
        insort(kept, (start, end, label, priority))
    return kept


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word's number, label) of every place where a base phrase stands."""
    out = []
    for phrase, label in BASE.items():
        i = -1
        try:
            while True:
                i = words.index(phrase[0], i + 1)
                if tuple(words[i : i + len(phrase)]) == phrase:
                    out.append((i, label))
        except ValueError:
            pass
    return sorted(out)


COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "n_detections long, detections string"
)


def scan(scanner: Scanner, text: str) -> tuple:
    """``COLUMNS`` of a text. The score is 1 - the product of each detection's doubt, 2^-priority
    for a rule and 2^-3 for a base place, so it is 0 only without any."""
    low = text.translate(_UPPER) if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    words = _WORD.findall(low)
    found = scanner.keywords(low)
    places = base_places(words) if any(p[0] in found for p in BASE) else []
    kept = scanner.detections(low, found)
    base = sorted({label for _, label in places})
    every = sorted({*base, *(label for _, _, label, _ in kept)})
    doubt = 2.0 ** -min(3 * len(places) + sum(p for *_, p in kept), 60)
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(base), ",".join(every), 1.0 - doubt, len(kept), ",".join(f"{label}:{a}:{z}" for a, z, label, _ in kept),
    )


def scans() -> Column:
    """A column function of whole texts: struct of ``COLUMNS``.

    Null and empty texts have no words, no labels (empty strings), null positions and score 0.
    Detections are in code points of the text, ends exclusive.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for texts in batches:
            frame = pd.DataFrame([scan(scanner, t) for t in strings(texts)], columns=names)
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return F.pandas_udf(run, COLUMNS)
