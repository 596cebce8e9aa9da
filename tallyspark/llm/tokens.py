"""Token counts by compiled finite-state transducers, for byte-level BPE vocabularies.

Two deterministic transducers stand for the tokenizer:

* the *splitter* reads character classes and marks where words begin. It has a dozen states, so
  a chunk of text is a map from states to states. A slice is cut into equal chunks, the maps of
  all chunks are built side by side, and a parallel prefix scan composes them into the state at
  which each chunk begins; a second run then reads off the marks.
* the *word* transducer reads the bytes of a word; each transition carries the change it makes
  to the number of emitted tokens. Its state holds, for each place at which a token can still be
  under way, the node in the vocabulary's trie, the last token before that place, and how many
  tokens ago it was. A word's prefix has one encoding, which ends in the one token that agrees
  with its predecessor: two tokens agree if the merges, applied to both their bytes, give just
  these two. States and transitions are compiled when first reached and kept; equal states of
  different words are one state.

Counts of short words are kept too. All stores are emptied at a fixed size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, strings

LIMIT = 512
CHUNK = 512
KEPT_WORDS, KEPT_STATES, KEPT_WORD_BYTES = 400_000, 250_000, 48

# Classes of characters, as the split pattern tells them apart.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, ONE, TWO, E, L, END = range(11)
N_CLASSES = 11
_LETTERS = {LETTER, ONE, TWO, E, L}
# Endings after an apostrophe: one letter; two letters of which the second is e, or l.
_SPECIAL = {" ": SPACE, "'": QUOTE, "s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": TWO, "v": TWO, "e": E, "l": L}
# States of the splitter: what the word read so far is.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, WANTS_E, WANTS_L, ENDED, ONE_SPACE, ONE_BLANK,
 RUN_SPACE, RUN_BLANK) = range(12)
N_STATES = 12
# Marks on a transition: a word begins at this character; one begins at the character before.
HERE, BEFORE = 1, 2


def _fresh(cls: int) -> int:
    """The state after the first character of a word."""
    if cls in _LETTERS:
        return IN_LETTERS
    return {OTHER: IN_OTHERS, NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: AT_QUOTE, END: START}[cls]


def _kind(cls: int) -> int | None:
    """The state of a run of this character's kind; none for white space and the end."""
    if cls in _LETTERS:
        return IN_LETTERS
    return {OTHER: IN_OTHERS, QUOTE: IN_OTHERS, NUMBER: IN_NUMBERS}.get(cls)


def _step(state: int, cls: int) -> tuple[int, int]:
    """Next state and marks.

    A word is an apostrophe with a known ending; or a run of letters, of numbers, or of other
    signs, with one space before it; or white space, without its last character where a word
    follows.
    """
    kind = _kind(cls)
    if state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS) and kind == state:
        return state, 0
    if state == AT_QUOTE:
        if cls == ONE:
            return ENDED, 0
        if cls == TWO:
            return WANTS_E, 0
        if cls == L:
            return WANTS_L, 0
        if kind == IN_OTHERS:
            return IN_OTHERS, 0
    if (state == WANTS_E and cls == E) or (state == WANTS_L and cls == L):
        return ENDED, 0
    if state in (WANTS_E, WANTS_L):  # the letter after the apostrophe began a word of its own
        return (IN_LETTERS, BEFORE) if kind == IN_LETTERS else (_fresh(cls), BEFORE | HERE)
    if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
        if cls in (SPACE, BLANK):
            return (RUN_SPACE if cls == SPACE else RUN_BLANK), 0
        if cls == END:
            return START, HERE
        split = BEFORE if state in (RUN_SPACE, RUN_BLANK) else 0
        if state in (ONE_SPACE, RUN_SPACE):
            return kind, split
        return _fresh(cls), split | HERE
    return _fresh(cls), HERE


_TABLE = [[_step(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)]
NEXT = np.array([[t[0] for t in row] for row in _TABLE], np.uint8).ravel()
MARKS = np.array([[t[1] for t in row] for row in _TABLE], np.uint8).ravel()


def marks(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The splitter's marks for each character, by composed chunk maps."""
    n = len(classes)
    width = max(1, -(-n // chunk))
    padded = np.full(width * chunk, END, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(width, chunk).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], width, axis=1)
    for row in steps:
        maps = NEXT[maps * np.uint8(N_CLASSES) + row]
    reach = 1
    while reach < width:  # after this round a map covers twice as many chunks
        later = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        maps = np.concatenate([maps[:, :reach], later], axis=1)
        reach *= 2
    state = np.full(width, START, np.uint8)
    state[1:] = maps[START, :-1]
    out = np.empty((chunk, width), np.uint8)
    for j, row in enumerate(steps):
        at = state * np.uint8(N_CLASSES) + row
        out[j], state = MARKS[at], NEXT[at]
    return out.T.ravel()[:n]


def character_classes(is_class) -> np.ndarray:
    """The class of every code point; ``is_class(pattern, text)`` tells which characters match."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\s", BLANK), (r"\p{N}", NUMBER), (r"\p{L}", LETTER)):
        out[points[is_class(pattern, text)]] = cls
    for sign, cls in _SPECIAL.items():
        out[ord(sign)] = cls
    return out


def library_matches(pattern: str, text: str) -> np.ndarray:
    """Which characters the tokenizer library's own expressions, with their edition of Unicode, match."""
    from tokenizers import Regex, normalizers

    kept = normalizers.Replace(Regex(pattern), "\0").normalize_str(text)
    before, after = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (text, kept))
    return before != after


def byte_letters() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabulary files: itself where it is
    visible, else the next sign from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """What a vocabulary file fixes: merges in order, tokens, special strings, character classes."""

    def __init__(self, merges: list[tuple[bytes, bytes]], tokens: list[bytes], special: list[str], classes: np.ndarray):
        self.merges, self.tokens, self.special, self.classes = merges, tokens, special, classes
        parts = (repr((merges, sorted(tokens), special)).encode(), classes.tobytes())
        self.digest = hashlib.sha256(b"".join(parts)).hexdigest()

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """From a byte-level BPE file; other kinds are refused."""
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        splitter, model = held["pre_tokenizer"] or {}, held["model"]
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
        )
        if not plain or held["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in held["added_tokens"]):
            raise ValueError(f"{path} has special strings that look at their neighbours")
        letter = byte_letters()
        special = [t["content"] for t in held["added_tokens"]]

        def raw(token: str) -> bytes:
            return bytes(letter[c] for c in token)

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        tokens = [raw(t) for t in model["vocab"] if t not in special]
        return cls([(raw(a), raw(b)) for a, b in pairs], tokens, special, character_classes(library_matches))


class WordTransducer:
    """Tokens of a word, by transitions that are compiled when first taken."""

    def __init__(self, tokenizer: Tokenizer):
        self.rank = {}
        for i, pair in enumerate(tokenizer.merges):
            self.rank.setdefault(pair, i)
        self.child: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for token in tokenizer.tokens:
            node = 0
            for byte in token:
                below = self.child[node]
                node = below.get(byte, 0)
                if not node:
                    node = below[byte] = len(self.token)
                    self.token.append(None)
                    self.child.append({})
            self.token[node] = token
        self.agreed: dict[tuple, bool] = {}
        self.splits: dict[bytes, tuple[bytes, bytes, int] | None] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.forget()

    def forget(self) -> None:
        self.agreed.clear()
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: By state and byte: the next state, and the change in the number of tokens plus 128.
        self.moves: dict[int, int] = {}
        self.number(((0, None, 0),))

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def merged(self, data: bytes) -> list[bytes]:
        """The merges applied one after another, the earliest in the list first, from the left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: bytes) -> tuple[bytes, bytes, int] | None:
        """The two parts of a token's last merge and its rank; None for single bytes and improper tokens."""
        if token not in self.splits:
            parts, halves = [token[i : i + 1] for i in range(len(token))], None
            while len(parts) > 1:
                ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == len(self.rank):
                    halves = None
                    break
                at = ranks.index(best)
                halves = parts[at], parts[at + 1], best
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = halves
        return self.splits[token]

    def agrees(self, last: bytes | None, token: bytes) -> bool:
        """Whether the merges give just these two tokens for their bytes.

        The two are built as if alone unless a merge across the border comes first. A part made
        by a merge is only merged by later ones, so the border moves outward through the parts
        of both tokens in the order of ranks; at equal ranks the merge further left goes first.
        """
        if last is None:
            return len(token) == 1 or self.split(token) is not None
        key = (last, token)
        known = self.agreed.get(key)
        if known is None:
            known = self.agreed[key] = self.agrees(None, token) and self._border_holds(last, token)
        return known

    def _border_holds(self, last: bytes, token: bytes) -> bool:
        rank, never = self.rank, len(self.rank)
        left, right = self.edge(last, 1), self.edge(token, 0)
        i = j = 0
        while True:
            (a, leaves), (b, joins) = left[i], right[j]
            across = rank.get((a, b), never)
            if across < leaves and across <= joins:
                return False
            if leaves == joins == never:
                return True
            if leaves <= joins:
                i += 1
            else:
                j += 1

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at a token's left (0) or right (1) edge from a byte to the whole, each with the
        rank of the merge that takes it up."""
        found = self.edges[side].get(token)
        if found is None:
            halves = self.split(token)
            if halves is None:
                found = [(token, len(self.rank))]
            else:
                found = [*self.edge(halves[side], side)[:-1], (halves[side], halves[2]), (token, len(self.rank))]
            self.edges[side][token] = found
        return found

    def compile(self, state: int, byte: int) -> int:
        child, token, agreed = self.child, self.token, self.agreed
        going = [(n, last, since) for node, last, since in self.states[state] if (n := child[node].get(byte))]
        for node, last, since in going:
            ends = token[node]
            if ends is not None:
                holds = agreed.get((last, ends))
                if self.agrees(last, ends) if holds is None else holds:
                    break
        else:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        change = 1 - since
        following = [(n, last, d + change) for n, last, d in going if child[n]]
        following.append((0, ends, 0))
        move = self.moves[state << 8 | byte] = self.number(tuple(following)) << 8 | change + 128
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self.forget()
        moves, state, total = self.moves, 0, -128 * len(word)
        for byte in word:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self.compile(state, byte)
            state = move >> 8
            total += move & 255
        return total


class Counter(dict):
    """Words to their numbers of tokens; words not met yet go through the transducer."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.words = tokenizer, WordTransducer(tokenizer)

    def __missing__(self, word: bytes) -> int:
        n = self.words.count(word)
        if len(word) <= KEPT_WORD_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n

    def segments(self, texts: Sequence[str]) -> tuple[list[str], list[int], np.ndarray]:
        """Texts cut at special strings: segments, the text of each, special strings per text.

        At each place the special string named first in the file is taken.
        """
        parts, owner, n_special = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            mine = [text]
            for special in self.tokenizer.special:
                if special in text:
                    mine = [p for part in mine for p in part.split(special)]
            n_special[i] = len(mine) - 1
            parts += mine
            owner += [i] * len(mine)
        return parts, owner, n_special

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """The number of tokens of each text of one slice."""
        parts, owner, totals = self.segments(texts)
        joined = "\0".join([*parts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        classes = self.tokenizer.classes[points]
        classes[ends] = END
        found = marks(classes)
        begins = (found & HERE).astype(bool)
        begins[:-1] |= (found[1:] & BEFORE).astype(bool)
        begins = np.flatnonzero(begins)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(sizes)])
        is_word = classes[begins] != END
        first = offset[begins]
        last = np.append(first[1:], offset[-1])[is_word].tolist()
        data = joined.encode("utf-8")
        words = [data[a:z] for a, z in zip(first[is_word].tolist(), last, strict=True)]
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        segment = np.searchsorted(ends, begins[is_word])
        of = np.asarray(owner, np.int64)[segment]
        return totals + np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)


#: Compiled tokenizers of this worker process, by the digest of what they were compiled from.
_COMPILED: dict[str, Counter] = {}


def counter(tokenizer: Tokenizer) -> Counter:
    found = _COMPILED.get(tokenizer.digest)
    if found is None:
        _COMPILED.clear()
        found = _COMPILED[tokenizer.digest] = Counter(tokenizer)
    return found


def token_counts(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the whole text. Null texts count as empty and have no tokens; special
    strings inside a text are one token each. Repeated rows and rows without an id stay as they
    are; an empty table gives an empty result; other columns are ignored. The tokenizer travels
    with the tasks: its size is the vocabulary's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = counter(shared.value)
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0, np.int64), *map(known.counts, slices(strings(texts)))]))

    text = F.coalesce(F.col(text_col), F.lit(""))
    n_tokens = F.pandas_udf(count, "long")(text)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
