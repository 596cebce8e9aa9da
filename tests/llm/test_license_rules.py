"""License rules: keywords that every match holds, and notices wrapped over lines."""

from __future__ import annotations

import random
from re import _constants as K
from re import _parser

import pytest

from tallyspark.llm import licenses

CLASSES = {K.CATEGORY_DIGIT: "3", K.CATEGORY_SPACE: " ", K.CATEGORY_NOT_SPACE: "x", K.CATEGORY_WORD: "w"}


def made(rng, tree):
    """A text that a parsed pattern matches."""
    out = ""
    for kind, value in tree:
        if kind is K.LITERAL:
            out += chr(value)
        elif kind is K.IN:
            if (K.NEGATE, None) in value:
                out += " "  # a gap within a line
                continue
            one, what = rng.choice(value)
            out += chr(what) if one is K.LITERAL else CLASSES[what] if one is K.CATEGORY else chr(what[0])
        elif kind is K.BRANCH:
            out += made(rng, rng.choice(value[1]))
        elif kind is K.SUBPATTERN:
            out += made(rng, value[3])
        elif kind is K.MAX_REPEAT:
            out += "".join(made(rng, value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
        else:
            assert kind in (K.AT, K.ASSERT_NOT), kind
    return out


def test_every_match_holds_a_keyword():
    rng = random.Random(2)
    scanner = licenses.Scanner()
    for i, rule in enumerate(scanner.rules):
        tree = _parser.parse(rule.pattern)
        for text in {made(rng, tree) for _ in range(60)}:
            assert i in {n for numbers in scanner.keywords(text).values() for n in numbers}, (rule, text)


@pytest.mark.parametrize(
    "text,label",
    [("Released under the GPLv3.", "gpl-3.0"), ("under GPL v2", "gpl-2.0"), ("LGPL v2.1", "lgpl-2.1"), ("LGPLv3", "lgpl-3.0"), ("the AGPL", "agpl")],
)
def test_short_names(text, label):
    assert licenses.scan(licenses.Scanner(), text)[5] == label


@pytest.mark.parametrize("turn", ["\n", "\n * ", "\r\n#   ", "  ", "\n// ", " \n\t"])
@pytest.mark.parametrize(
    "text,label",
    [
        ("Redistribution and use in source and binary forms, with or without modification", "bsd"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "isc"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Mozilla Public License Version 1.1", "mpl-1.1"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ],
)
def test_wrapped_notices(text, label, turn):
    """Each blank turned in its place, and all at once: one detection of the whole notice, offsets of the text."""
    scanner = licenses.Scanner()
    words = text.split(" ")
    for at in range(1, len(words)):
        low = (" ".join(words[:at]) + turn + " ".join(words[at:])).lower()
        assert [d[:3] for d in scanner.detections("x " + low)] == [(2, 2 + len(low), label)], low
    low = turn.join(words).lower()
    assert [d[:3] for d in scanner.detections("x " + low)] == [(2, 2 + len(low), label)]


def test_no_version_from_a_list():
    assert licenses.scan(licenses.Scanner(), "the GNU GPL\n1. You may")[5] == ""
    assert licenses.scan(licenses.Scanner(), "the GNU GPL 1.0")[5] == "gpl-1.0"


@pytest.mark.parametrize(
    "text,labels",
    [
        ("under the Apache License, Version 1.0 of old", "apache"), ("the Apache License", "apache"),
        ("the Apache License 2.0", "apache-2.0"), ("Licensed under the Apache License (v2)", "apache-2.0"),
        ("Mozilla Public License 1.0", "mpl"), ("Mozilla Public License, v. 2.0", "mpl-2.0"),
        ("Eclipse Public License", "epl"), ("Eclipse Public License - v 2.0", "epl"), ("Eclipse Public License 2.0", "epl-2.0"),
        ("GNU Affero General Public License", "agpl,gpl"), ("AGPL v3", "agpl-3.0"), ("the Open Software License", "osl"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
        ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: ISC AND (BSD-3-Clause OR Zlib)", "bsd-3-clause,isc,zlib"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0"),
        ("SPDX-License-Identifier: MITx", ""), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa-4.0"),
    ],
)
def test_labels_name_only_what_the_text_names(text, labels):
    assert licenses.scan(licenses.Scanner(), text)[5] == labels
