"""Quality rules, license scans and personal data against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGES
from pyspark.sql import functions as F

from tallyspark.llm import divergence, licenses, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The house of the old man is in the town, and it was on the road to the sea. "


def rows_of(df, column):
    return df.select("doc_id", column(F.col("text")).alias("r")).select("doc_id", "r.*").collect()


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_quality_base(frame):
    rng = random.Random(4)
    rows = list(EDGES)
    for i in range(60):
        words = [rng.choice(["a", "b", "c", "über", "x#y", "|"]) if i % 2 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(90))]
        rows.append((200 + i, "".join(w + rng.choice([" ", "\n", "\n\n", "  "]) for w in words) + "dup line\n" * (i % 4)))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows_of(frame(rows), divergence.rules()))
    assert got == Counter((i, *base_rules(t)) for i, t in rows)
    assert rows_of(frame([(1, "x")]).where("false"), divergence.rules()) == []


def test_quality_verdicts(frame):
    rng = random.Random(8)
    names = divergence.COMMON["en"]
    words = [rng.choice(names[: rng.randint(1, 20)]) if rng.random() < 0.3 else f"word{chr(97 + i % 26)}{chr(97 + i % 23)}" for i in range(400)]
    prose = " ".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, 400, 12))
    rows = [(1, prose), (2, " ".join(w.upper() + "!!" for w in prose.split())), (3, " ".join(w + "###" for w in prose.split())), (4, " | ".join(prose.split()))]
    kept = {r.doc_id: r.kept for r in rows_of(frame(rows), divergence.rules())}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_distance_is_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.4, 0.5])
    m = (p + q) / 2
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    assert divergence.distance(p, q) == pytest.approx(math.sqrt((kl(p, m) + kl(q, m)) / 2))
    assert divergence.distance(p, p) == 0 and divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def base_licenses(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = [(i, y) for i in range(len(words)) for p, y in phrases.items() if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({y for _, y in places}))


LICENSED = [
    (301, "Licensed under CC BY-NC 4.0. All rights reserved.", "cc-by,cc-by-nc-4.0,reserved"),
    (302, "Released under the MIT License.", "mit"),
    (303, "the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    (304, "Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    (305, "SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    (306, "see https://creativecommons.org/licenses/by-sa/4.0 for CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    (307, "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    (308, "Un mit und MIT, all the rights, reserved general license of the public", ""),
    (309, "ALL RIGHTS\nRESERVED cc, by; cc by all rights reserved", "cc-by,reserved"),
    (310, "GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
]


def test_licenses(frame):
    rows = EDGES + [(i, t) for i, t, _ in LICENSED]
    got = rows_of(frame(rows), licenses.scans())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(
        (i, *base_licenses(t)) for i, t in rows
    )
    labels = {r.doc_id: r.labels for r in got}
    assert {i: labels[i] for i, _, _ in LICENSED} == {i: y for i, _, y in LICENSED}
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert rows_of(frame(rows).where("false"), licenses.scans()) == []


def test_keyword_gate_loses_nothing():
    """Every rule without the gate finds what the gated scan finds, on texts made from all rules."""
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 300
    for text in [t.lower() for _, t, _ in LICENSED]:
        every = {k: v for k, v in scanner.gate.values()}
        assert scanner.detections(text) == scanner.detections(text, every)


def test_suppression():
    raw = [(0, 10, "long", 3, 0), (2, 6, "inside", 3, 1), (2, 6, "strong", 6, 2), (20, 25, "free", 1, 3), (24, 30, "weak", 1, 4)]
    assert licenses.suppress(raw) == [(2, 6, "strong", 6), (24, 30, "weak", 1)]


def slow_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19:
            s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
            if s % 10 == 0:
                out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def chain():
    return pii.learn()


def test_pii_base_spans_by_fuzz():
    rng = random.Random(6)
    bits = ["@", ".", "a", "b1", "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "+1 (415) 555-0132", " ", "-", "+", "é", "12", "x@y.z", "%", "\n", "5500005555555559"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == slow_pii(text), text


def test_pii_columns_and_edges(frame, chain):
    rows = EDGES + [(401, "mail a.b@c.org, from 10.0.0.1 or +44 20 7946 0958 now"), (402, 'here token = "44e15e09fd311c3cf3163b66d5a9875b883d8ce0" is')]
    got = rows_of(frame(rows), pii.finder(chain))
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    one = by_id[401]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 1)
    text = "email:5:14,ip:21:29,phone:33:49"
    assert one.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and one.spans == text
    assert by_id[402].spans == "secret:14:54" and by_id[402].n_added == 1
    assert all(by_id[i].spans == "" for i in (101, 102, 103, 104, 105, 106, 107, 108))
    assert rows_of(frame(rows).where("false"), pii.finder(chain)) == []


def test_pii_field_finds_what_patterns_miss(chain):
    held_out = {
        "please ring (040) 555-0123 today": ["phone"],
        "Token = \"0f343b0931126a20f133d67c2b018a3b12cd34ef\" of it": ["secret"],
        "write bob at mail dot org soon": ["email"],
        "it was at the end of 2019, chapter 4 of 12": [],
        "the year 1984 and the number 27182818 of 300": [],
        "THE!! WORDS!! ARE!! LOUD!!": [], "alpha### beta*** gamma%%%": [],
    }
    for text, kinds in held_out.items():
        ((_, spans),) = pii.find_spans(chain, [text])
        assert [k for k, _, _ in spans] == kinds, text


def test_redaction(frame, chain):
    df = frame([(1, "mail a@b.org or 10.0.0.1 !"), (2, None), (3, "")])
    got = {r.doc_id: r.t for r in df.select("doc_id", pii.redactor(chain)("text").alias("t")).collect()}
    assert got == {1: "mail [EMAIL] or [IP] !", 2: None, 3: ""}
    assert pii.redacted("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"
