"""Sampled subword encodings: Gumbel top-k without replacement over the piece lattice.

A public piece vocabulary is read (its path is a parameter), never trained. Merge ranks stand
in for piece probabilities by Zipf's law, which makes every text a lattice with a normalised
distribution over its segmentations. The ``k`` segmentations with the largest Gumbel-perturbed
log-probability are ``k`` draws without replacement; they are found by A-star search:

- a set of segmentations is described by its common beginning and the edges barred next; its
  perturbed maximum is a Gumbel variable at the set's log-mass, truncated by the maximum of the
  set it was split from, so the best set on the agenda holds the next segmentation;
- taking a set draws the segmentation that attains its maximum, edge by edge from the backward
  marginals, and splits the rest into one new set for each edge of the drawn path.

No piece crosses the start of a space run or a line break, so the lattice of a text is a chain
of small ones; those of distinct chunks are built once and kept. All randomness is a hash of
the row's key, the draw and the place, so it hangs on no batch or partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType,
)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SPACE = "▁"
#: Edges kept in a worker's store of lattices before it starts anew.
STORE_EDGES = 2_000_000
#: Characters of texts in work at once.
SLICE_CHARS = 250_000

class Trie:
    """All beginnings of the pieces as a double array, for many steps at once.

    A state's child by a character stands ``base`` of the state plus the character's class further on, in a slot
    that names the state as its owner; a slot's number is the child's state. Class 0 is that of all other characters.
    """

    def __init__(self, pieces: dict[str, int]):
        letters = sorted({c for piece in pieces for c in piece})
        self.class_of = np.zeros(0x110000, np.min_scalar_type(len(letters)))
        self.class_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: i for i, c in enumerate(letters, 1)}
        children: dict[str, dict[int, str]] = {"": {}}
        for piece in pieces:
            for z in range(1, len(piece) + 1):
                children.setdefault(piece[: z - 1], {})[number[piece[z - 1]]] = piece[:z]
        # the states with most children first, each where all its children find free slots; then those with one child
        order = sorted(children, key=lambda prefix: -len(children[prefix]))
        many = sum(len(mine) > 1 for mine in children.values())
        free = np.ones(4 * len(letters) + 64 + 2 * sum(map(len, children.values())), bool)
        free[: len(letters) + 1] = False  # states without children have base 0 and must own nothing there
        bases, low = np.zeros(len(order), np.int64), len(letters) + 1
        for i, prefix in enumerate(order[:many]):
            classes, at = np.array(sorted(children[prefix]), np.int64), low
            while True:
                if at + 64 + len(letters) >= len(free):
                    free = np.append(free, np.ones(len(free), bool))
                tried = np.arange(at, at + 64) - classes[0]
                fits = free[tried[:, None] + classes].all(axis=1)
                if fits.any():
                    break
                at += 64
            bases[i] = tried[fits.argmax()]
            free[bases[i] + classes] = False
            low = max(low, at - 64)  # fuller slots are left to single children
        lone = np.array([next(iter(children[prefix])) for prefix in order[many:]], np.int64)
        free = np.append(free, np.ones(len(lone), bool))
        bases[many:] = np.flatnonzero(free)[: len(lone)] - lone
        state = {"": 0}
        for prefix, base in zip(order, bases.tolist(), strict=True):
            state.update((child, base + c) for c, child in children[prefix].items())
        n_slots = len(free) + len(letters) + 1  # any class can be added to any base
        self.base = np.zeros(n_slots, np.int64)
        self.owner = np.full(n_slots, -1, np.int64)
        self.piece = np.full(n_slots, -1, np.int32)
        for prefix, base in zip(order, bases.tolist(), strict=True):
            self.base[state[prefix]] = base
            self.owner[[base + c for c in children[prefix]]] = state[prefix]
        self.piece[[state[piece] for piece in pieces]] = list(pieces.values())

    def edges(self, codes: np.ndarray, follow: np.ndarray):
        """All pieces that begin at each character: (piece, start, number among the start's, stop), and how many.

        ``follow`` has the place of each character's next one; behind a chunk's last it is the length of ``codes``.
        """
        classes = np.append(self.class_of[codes], 0).astype(np.int64)
        follow = np.append(follow, len(codes))
        count = np.zeros(len(codes), np.int64)
        at, here, state, found = np.arange(len(codes)), None, 0, []
        while len(at):
            if here is None:
                here, slot = at, self.base[0] + classes[:-1]
            else:
                slot = self.base.take(state)
                slot += classes.take(here)
            on = np.flatnonzero(self.owner.take(slot) == state)
            at, state, here = at.take(on), slot.take(on), follow.take(here.take(on))
            piece = self.piece.take(state)
            whole = np.flatnonzero(piece >= 0)
            start = at.take(whole)
            rank = count.take(start)
            count[start] = rank + 1
            found.append((piece.take(whole), start, rank, here.take(whole)))
        ids, start, rank, stop = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(4))
        return ids.astype(np.int64), start, rank, stop, count


@dataclass
class Vocabulary:
    """The pieces, their log-weights, and the bytes of each number."""

    trie: Trie
    weight: np.ndarray
    raw: list[bytes]
    byte_ids: list[int]
    raw_array: pa.Array

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces, weight, raw, byte_ids = {}, np.zeros(n), [b""] * n, [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                raw[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                rank = -sp.get_score(i)
                pieces[piece] = i
                weight[i] = -math.log(2 + (rank if rank < 1e8 else 0))  # rank 1e9: runs of spaces
                raw[i] = piece.encode()
        return cls(Trie(pieces), weight, raw, byte_ids, pa.array(raw, pa.large_binary()))

    def spells(self, ids, text: str) -> bool:
        """Whether the pieces decode to ``text``, its own space marks read as spaces."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return data == marked(text).encode("utf-8", "replace") or self.decode(ids) == text.replace(SPACE, " ")

    def all_spell(self, ids: np.ndarray, ends: np.ndarray, texts: Sequence[str]) -> list[bool]:
        """``spells`` for many sequences: the ``i``-th ends at ``ends[i]`` and is to spell ``texts[i]``."""
        run = self.raw_array.take(pa.array(ids))
        at = np.frombuffer(run.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = run.buffers()[2].to_pybytes() if len(ids) else b""
        first, first_id, same, before, want = 0, 0, [], None, b""
        for end_id, end, text in zip(ends.tolist(), at[ends].tolist(), texts, strict=True):
            if text is not before:
                before, want = text, marked(text).encode("utf-8", "replace")
            whole = end - first == len(want) and data.startswith(want, first)
            same.append(whole or self.spells(ids[first_id:end_id].tolist(), text))
            first, first_id = end, end_id
        return same

    def decode(self, ids) -> str:
        """The text of a piece sequence; spaces come back from their mark."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def marked(text: str) -> str:
    """The text as the lattice sees it: one space in front, spaces as their mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Store:
    """Lattices of chunks, edge after edge, those of a node side by side, in growing arrays.

    Chunks are found by a 64-bit hash in an open table and then compared by their characters.
    """

    #: Slots of the table at first, a power of two; it doubles before it is half full.
    SLOTS = 2**17

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.share = np.zeros(0)  # cumulated probability, the order edges are drawn by; a node's last has infinity
        self.log_q = np.zeros(0, np.float32)
        self.log_rest = np.zeros(0, np.float32)  # log of the mass of the node's other edges
        self.lead = np.zeros(0, np.int32)  # the first edge of the node an edge leads to, -1 at the chunk's end
        self.piece = np.zeros(0, np.int32)  # below 0: -1 - the row of ``spelt`` with a character's bytes
        self.head = np.zeros(0, np.int64)  # of each chunk: its first edge, where its letters lie, their number
        self.letters_at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.letters = np.zeros(0, np.uint32)
        self.power = np.ones(1, np.uint64)
        self.reset()

    def reset(self) -> None:
        self.edges = self.widest = self.chunks = self.n_letters = self.taken = 0
        self.keys, self.values = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64)  # key 0: a free slot
        self.row_of: dict[int, int] = {}
        self.spelt = np.zeros((0, 4), np.int32)
        self.n_spelt = np.zeros(0, np.int64)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write behind what is there; arrays grow by a quarter, so that few copies are made."""
        own = getattr(self, name)
        if at + len(values) > len(own):
            grown = np.zeros(max(at + len(values), len(own) * 5 // 4), own.dtype)
            grown[:at] = own[:at]
            setattr(self, name, grown)
            own = grown
        own[at : at + len(values)] = values

    def _spell(self, codes: np.ndarray) -> np.ndarray:
        """The row of ``spelt`` of each character."""
        distinct, which = np.unique(codes, return_inverse=True)
        new = [c for c in distinct.tolist() if c not in self.row_of]
        if new:
            data = [chr(c).encode("utf-8", "replace") for c in new]
            table = np.zeros((len(new), 4), np.int32)
            for row, letters in zip(table, data, strict=True):
                row[: len(letters)] = [self.vocab.byte_ids[b] for b in letters]
            self.row_of.update(zip(new, range(len(self.row_of), len(self.row_of) + len(new)), strict=True))
            self.spelt = np.concatenate([self.spelt, table])
            self.n_spelt = np.concatenate([self.n_spelt, [len(letters) for letters in data]])
        return np.array([self.row_of[c] for c in distinct.tolist()], np.int64)[which]

    def hashes(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number above 0 for each of the chunks that make up ``codes``."""
        longest = int(size.max())
        if longest > len(self.power):
            self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * longest, 0x9E3779B97F4A7C15, np.uint64)))
        x = self.power.take(np.arange(len(codes)) - np.repeat(begin, size))
        x *= codes + np.uint64(1)
        h = np.add.reduceat(x, begin)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.maximum(h, np.uint64(1))

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The chunk of each hash, -1 where there is none."""
        out, slot, rows = np.full(len(hashes), -1), self._slots(hashes), np.arange(len(hashes))
        while len(rows):
            key = self.keys.take(slot)
            hit = np.flatnonzero(key == hashes)
            out[rows.take(hit)] = self.values.take(slot.take(hit))
            on = np.flatnonzero((key != hashes) & (key > 0))
            rows, hashes, slot = rows.take(on), hashes.take(on), (slot.take(on) + 1) % len(self.keys)
        return out

    def _enter(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Enter chunks under their hashes, which are distinct and not in the table."""
        self.taken += len(hashes)
        if 2 * self.taken > len(self.keys):
            there = np.flatnonzero(self.keys)
            hashes, values = np.append(self.keys[there], hashes), np.append(self.values[there], values)
            n = 2 ** int(4 * self.taken).bit_length()
            self.keys, self.values = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        slot = self._slots(hashes)
        while len(hashes):
            free = np.flatnonzero(self.keys.take(slot) == 0)
            self.keys[slot[free]] = hashes[free]  # of several for one slot the last stays
            self.values[slot[free]] = values[free]
            on = np.flatnonzero(self.keys.take(slot) != hashes)
            hashes, values, slot = hashes[on], values[on], (slot[on] + 1) % len(self.keys)

    def starts(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The first edge of each of the chunks that make up ``codes``; new ones are added."""
        size = np.diff(begin, append=len(codes))
        h = self.hashes(codes, begin, size)
        chunk = self.lookup(h)
        new = np.flatnonzero(chunk < 0)
        if len(new):
            distinct, at, which = np.unique(h[new], return_index=True, return_inverse=True)
            added = self.add(codes, begin[new[at]], size[new[at]])
            self._enter(distinct, added)
            chunk[new] = added[which]
        other = self.length.take(chunk) != size
        chunk[other] = -1
        where = np.repeat(np.where(other, 0, self.letters_at.take(chunk, mode="wrap") - begin), size)
        where += np.arange(len(codes))
        wrong = np.flatnonzero(self.letters.take(where, mode="clip") != codes)
        strange = np.union1d(np.flatnonzero(other), np.searchsorted(begin, wrong, side="right") - 1)
        if len(strange):  # other chunks of a hash in the table: built for this once
            chunk[strange] = self.add(codes, begin[strange], size[strange])
        return self.head.take(chunk)

    def add(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Build the lattices of new chunks, all at once; their numbers.

        Characters are laid out by their place in the chunk, the last places first and the longest chunks first
        within a place. So the edges of a place lie side by side, behind those they lead to.
        """
        vocab = self.vocab
        order = np.argsort(-size, kind="stable")
        sorted_begin = begin[order]
        n_at = np.searchsorted(-size[order], -np.arange(size.max()), side="left")  # chunks that have a place
        offset = np.cumsum(n_at[::-1])[::-1] - n_at
        n = int(n_at.sum())
        text = np.empty(n, np.uint32)
        follow = np.full(n, n)
        for place, (first, many) in enumerate(zip(offset.tolist(), n_at.tolist(), strict=True)):
            text[first : first + many] = codes.take(sorted_begin[:many] + place)
            if place + 1 < len(n_at):
                more = int(n_at[place + 1])
                follow[first : first + more] = np.arange(first - more, first)

        ids, start, rank, stop, count = vocab.trie.edges(text, follow)
        weight = vocab.weight[ids]
        one = np.zeros(n, bool)
        one[start[(stop == follow[start])]] = True
        lone = np.flatnonzero(~one)
        if len(lone):  # characters without a piece: their bytes, before all longer pieces
            row = self._spell(text[lone])
            rank[~one[start]] += 1
            count[lone] += 1
            ids, weight = np.concatenate([ids, -1 - row]), np.concatenate([weight, -self.n_spelt[row] * math.log(len(vocab.weight))])
            start, stop, rank = np.concatenate([start, lone]), np.concatenate([stop, follow[lone]]), np.concatenate([rank, np.zeros(len(lone), np.int64)])
        head = np.cumsum(count) - count
        slot = head.take(start)
        slot += rank
        total = len(slot)
        order_of = np.empty(total, np.int64)
        order_of[slot] = np.arange(total)
        ids, weight, stop = ids.take(order_of), weight.take(order_of), stop.take(order_of)

        beta = np.zeros(n + 1)  # the last: behind a chunk's end
        log_q = np.empty(total)
        edge_ends = np.append(head, total)
        for low, high in zip(offset[::-1].tolist(), (offset + n_at)[::-1].tolist(), strict=True):
            a, z = int(edge_ends[low]), int(edge_ends[high])
            heads, many = head[low:high] - a, count[low:high]
            value = beta.take(stop[a:z])
            value += weight[a:z]
            top = np.maximum.reduceat(value, heads)
            mass = np.add.reduceat(np.exp(value - np.repeat(top, many)), heads)
            mine = top + np.log(mass)
            beta[low:high] = mine
            np.subtract(value, np.repeat(mine, many), out=log_q[a:z])

        q = np.exp(log_q)
        run = np.cumsum(q)
        mass = np.add.reduceat(q, head)
        share = (run - np.repeat(run[head] - q[head], count)) / np.repeat(mass, count)
        np.minimum(share, 1.0, out=share)
        share[head + count - 1] = math.inf
        rest = np.maximum(np.repeat(mass, count) - q, 1e-300)
        rest[head[count == 1]] = 0.0
        with np.errstate(divide="ignore"):
            log_rest = np.log(rest)
        lead = np.append(head + self.edges, -1).take(stop)
        for name, values in (("share", share), ("log_q", log_q), ("log_rest", log_rest), ("lead", lead), ("piece", ids)):
            self._put(name, self.edges, values)
        first = np.empty(len(order), np.int64)
        first[order] = head[offset[0] :] + self.edges
        before = np.cumsum(size) - size
        self._put("letters", self.n_letters, codes.take(np.arange(n) + np.repeat(begin - before, size)))
        for name, values in (("head", first), ("letters_at", before + self.n_letters), ("length", size)):
            self._put(name, self.chunks, values)
        self.edges += total
        self.n_letters += n
        self.chunks += len(order)
        self.widest = max(self.widest, int(count.max()))
        return np.arange(self.chunks - len(order), self.chunks)

    def pick(self, edge: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge at quantile ``u`` of the probabilities of each node, whose first edge is given."""
        edge = edge.astype(np.int64)
        more = np.flatnonzero(self.share.take(edge) <= u)
        while len(more):
            further = edge.take(more)
            further += 1
            edge[more] = further
            more = more.compress(self.share.take(further) <= u.take(more))
        return edge

    def pieces(self, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of edges, and where those of the edges before each of ``bounds`` end."""
        ids = self.piece.take(edges)
        bytewise = np.flatnonzero(ids < 0)
        if len(bytewise) == 0:
            return ids, bounds
        n = np.ones(len(ids), np.int64)
        n[bytewise] = self.n_spelt[-1 - ids[bytewise]]
        ends = np.concatenate([[0], np.cumsum(n)])
        step = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
        ids = np.repeat(ids, n)
        bytewise = np.flatnonzero(ids < 0)
        ids[bytewise] = self.spelt[-1 - ids[bytewise], step[bytewise]]
        return ids, ends[bounds]


def stream(seed, draw: int, place) -> np.ndarray:
    """The numbers of a row's seed, a draw and a place: where their hashes begin."""
    x = np.asarray(place, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x + (np.asarray(seed, np.uint64) + np.uint64((draw + 1) * 0xD1342543DE82EF95 % 2**64))


def uniform(streams: np.ndarray, step: int = 0) -> np.ndarray:
    """Numbers in (0, 1) by hashing (splitmix64), the ``step``-th of each stream."""
    x = streams + np.uint64(step * 0xBF58476D1CE4E5B9 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def seed_of(row_key) -> int:
    return xxhash.xxh64_intdigest(repr(row_key).encode(), 3)


def _draw(store: Store, starts: np.ndarray, streams: np.ndarray, step: int = 0):
    """One edge path from each first edge of a node; edges end to end and their number for each."""
    live, count, taken = np.arange(len(starts)), np.zeros(len(starts), np.int64), []
    while len(live):
        edge = store.pick(starts, uniform(streams, step))
        taken.append((live, edge))
        step += 1
        count[live] = len(taken)
        starts = store.lead.take(edge)
        on = np.flatnonzero(starts >= 0)
        live, starts, streams = live.take(on), starts.take(on), streams.take(on)
    offset = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for n, (live, edge) in enumerate(taken):
        at = offset.take(live)
        at += n
        out[at] = edge
    return out, count


def _truncated(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``log_mass`` given that they stay below ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return log_mass - np.log(np.exp(log_mass - bound) - np.log(u))


@dataclass
class Paths:
    """A path for each of the texts, and the sets split off along it."""

    edges: np.ndarray
    at: np.ndarray  # where the edges of each chunk begin; after the last chunk, their number
    begin: np.ndarray  # where the edges of each text begin
    size: np.ndarray  # 0: the text has no such path
    bound: np.ndarray  # the perturbed value of the path
    from_step: np.ndarray  # sets split off before belong to other paths; -1 for the first path
    barred: np.ndarray  # edges barred at that step; of the first path, none
    log_left: np.ndarray  # log of the mass of the other edges at that step
    values: list  # the value of each set of a text, by step
    top: np.ndarray  # the largest of them
    top_step: np.ndarray


class Search:
    """The agendas of many texts at once, a path of each text a round."""

    #: Steps of a path that are scored first.
    STEPS = 64

    def __init__(self, store: Store, seeds: np.ndarray, starts: np.ndarray, first: np.ndarray, fresh: list):
        """``starts``: the first edge of each chunk; ``first``: each text's first chunk, and the number of chunks;
        ``fresh``: edges of all chunks, and where those of each begin, by draw."""
        self.store, self.seeds, self.starts, self.first, self.fresh = store, seeds, starts, first, fresh
        self.paths: list[Paths] = []

    def _score(self, p: Paths, need: int) -> None:
        """Score the sets split off along the paths, so far that the ``need`` best of each are known.

        A Gumbel number made of 53 random bits is below 38, so sets of a mass under e^-38 of a
        value found can't pass it; the scoring stops where no set can be among the best any more.
        """
        store, draw, rows, width = self.store, len(self.paths), np.flatnonzero(p.size), self.STEPS
        while len(rows):
            size = p.size[rows]
            step = np.arange(min(width, int(size.max())))
            inside = step < size[:, None]
            edge = p.edges.take(np.where(inside, p.begin[rows, None] + step, 0))
            after = np.cumsum(np.where(inside, store.log_q.take(edge), 0.0), axis=1, dtype=np.float64)
            before = np.concatenate([np.zeros((len(rows), 1)), after[:, :-1]], axis=1)
            mass = before + store.log_rest.take(edge)
            split = np.flatnonzero((p.from_step[rows] >= 0) & (p.from_step[rows] < len(step)))
            at = p.from_step[rows[split]]
            mass[split, at] = before[split, at] + p.log_left[rows[split]]
            values = _truncated(mass, p.bound[rows, None], uniform(stream(self.seeds[rows, None], 1000 + draw, step)))
            values[~inside | (step < p.from_step[rows, None])] = -math.inf
            last = np.partition(values, -need, axis=1)[:, -need] if need <= len(step) else np.full(len(rows), -math.inf)
            done = (size <= len(step)) | (after[:, -1] < last - 38)
            p.top_step[rows] = values.argmax(axis=1)
            p.top[rows] = values.max(axis=1)
            for i in np.flatnonzero(done).tolist():
                p.values[rows[i]] = values[i]
            rows, width = rows[~done], width * 4

    def _push(self, edges, at, bound, from_step, barred, log_left, need: int) -> None:
        n, ends = len(self.seeds), at[self.first]
        p = Paths(edges, at, ends[:-1], np.diff(ends), bound, from_step, barred, log_left,
                  [None] * n, np.full(n, -math.inf), np.zeros(n, np.int64))
        self._score(p, need)
        self.paths.append(p)

    def run(self, k: int) -> np.ndarray:
        """The ``k`` best paths of each text in ``paths``; returned is each text's next best value."""
        n = len(self.seeds)
        bound = -np.log(-np.log(uniform(stream(self.seeds, 999, 0))))
        self._push(*self.fresh[0], bound, np.full(n, -1), np.zeros((n, 0), np.int64), np.zeros(n), k)
        while True:
            tops = np.stack([p.top for p in self.paths])
            source = tops.argmax(axis=0)
            value = tops[source, np.arange(n)]
            if len(self.paths) == k or not (value > -math.inf).any():
                return value
            self._split(source, value, k - len(self.paths))

    def _split(self, source: np.ndarray, value: np.ndarray, need: int) -> None:
        """Take the best set of each text: draw its path, and split the rest of the set along it."""
        store, draw, n, n_chunks = self.store, len(self.paths), len(self.seeds), len(self.starts)
        texts = np.flatnonzero(value > -math.inf)
        edges, at, step, head, old, here, inner = (np.zeros(n, np.int64) for _ in range(7))
        barred = np.full((n, draw + 1), -1, np.int64)
        for s, p in enumerate(self.paths):
            mine = texts[source[texts] == s]
            step[mine] = p.top_step[mine]
            at[mine] = p.begin[mine] + step[mine]
            here[mine] = np.searchsorted(p.at, at[mine], side="right") - 1
            inner[mine] = at[mine] - p.at[here[mine]]
            old[mine] = p.edges[at[mine]]
            head[mine] = np.where(inner[mine] > 0, store.lead[p.edges[at[mine] - 1]], self.starts[here[mine]])
            barred[mine, 0] = old[mine]
            again = mine[p.from_step[mine] == step[mine]]  # part of this set was taken before
            barred[again, : p.barred.shape[1]] = p.barred[again]
            for t in mine.tolist():  # the rest of this set goes on with the new path
                p.values[t][step[t]] = -math.inf
                p.top_step[t] = p.values[t].argmax()
                p.top[t] = p.values[t][p.top_step[t]]

        others = np.minimum(head[texts, None] + np.arange(store.widest), store.edges - 1)
        last = np.isinf(store.share.take(others))
        gone = (np.cumsum(last, axis=1) - last) > 0  # behind the node's last edge
        gone |= (others[:, :, None] == barred[texts, None, :]).any(axis=2)
        weight = np.where(gone, 0.0, np.exp(store.log_q.take(others).astype(np.float64)))
        run = np.cumsum(weight, axis=1)
        mark = uniform(stream(self.seeds[texts], 2000 + draw, step[texts])) * run[:, -1]
        chosen = (run <= np.minimum(mark, np.nextafter(run[:, -1], 0.0))[:, None]).sum(axis=1)
        edges[texts] = others[np.arange(len(texts)), chosen]
        weight[np.arange(len(texts)), chosen] = 0.0
        log_left = np.full(n, -math.inf)
        with np.errstate(divide="ignore"):
            log_left[texts] = np.log(weight.sum(axis=1))
        barred[texts, draw] = edges[texts]

        lead = store.lead.take(edges)
        on = texts[lead[texts] >= 0]
        middle, n_middle = _draw(store, lead[on], stream(self.seeds[on], 3000 + draw, step[on]), 1)
        n_mid = np.zeros(n, np.int64)
        n_mid[on] = n_middle
        mid_end = np.cumsum(n_mid)
        tail, tail_at = self.fresh[draw]
        tail_from, tail_to = tail_at[np.minimum(here + 1, n_chunks)], tail_at[self.first[1:]]
        parts = []
        for t in texts.tolist():
            p = self.paths[source[t]]
            parts += [p.edges[p.begin[t] : at[t]], edges[t : t + 1], middle[mid_end[t] - n_mid[t] : mid_end[t]], tail[tail_from[t] : tail_to[t]]]

        text_of = np.repeat(np.arange(n), np.diff(self.first))
        chunk, turn = np.arange(n_chunks), here[text_of]
        size = np.where(chunk < turn, np.stack([np.diff(p.at) for p in self.paths])[source[text_of], chunk], np.diff(tail_at))
        size[here[texts]] = (inner + 1 + n_mid)[texts]
        size[(value == -math.inf)[text_of]] = 0
        self._push(np.concatenate(parts), np.concatenate([[0], np.cumsum(size)]), value, step, barred, log_left, need)


def _chunks(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all marked texts, where their chunks begin, and the number of each text's chunks.

    A chunk is a run of spaces with what follows it up to a space or line break, or a run of line breaks.
    """
    lattice_texts = list(map(marked, texts))
    codes = np.frombuffer("".join(lattice_texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lattice_texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    space, line = codes == ord(SPACE), codes == ord("\n")
    start = np.ones(len(codes), bool)
    start[1:] = (space[1:] & ~space[:-1]) | (line[1:] != line[:-1])
    start[(ends - sizes)[sizes > 0]] = True
    begin = np.flatnonzero(start)
    return codes, begin, np.diff(np.searchsorted(begin, ends), prepend=0)


def _slice_samples(store: Store, keys: list, texts: list[str], k: int) -> Iterator[list[tuple]]:
    """The samples of each text: (log-probability, perturbed value, inclusion, ids) of each."""
    codes, begin, counts = _chunks(texts)
    if store.edges > STORE_EDGES:
        store.reset()
    full = np.flatnonzero(counts)
    found: list[list[tuple]] = [[] if n else [(0.0, 0.0, 1.0, np.zeros(0, np.int32))] for n in counts.tolist()]
    if len(full):
        starts = store.starts(codes, begin)
        seeds = np.array([seed_of(keys[d]) for d in full.tolist()], np.uint64)
        first = np.concatenate([[0], np.cumsum(counts[full])])
        places = np.arange(len(starts)) - np.repeat(first[:-1], counts[full])
        of_text, fresh = np.repeat(seeds, counts[full]), []
        for draw in range(k):
            edges, n = _draw(store, starts, stream(of_text, draw, places))
            fresh.append((edges, np.concatenate([[0], np.cumsum(n)])))
        search = Search(store, seeds, starts, first, fresh)
        threshold = search.run(k).tolist()
        for p in search.paths:
            rows = np.flatnonzero(p.size)
            log_p = np.add.reduceat(store.log_q.take(p.edges), p.begin[rows], dtype=np.float64).tolist()
            ids, ends = store.pieces(p.edges, np.append(p.begin[rows], len(p.edges)))
            ends = ends.tolist()
            for i, (t, d, value) in enumerate(zip(rows.tolist(), full[rows].tolist(), p.bound[rows].tolist(), strict=True)):
                passed = -math.expm1(-math.exp(min(log_p[i] - threshold[t], 700.0))) if threshold[t] > -math.inf else 1.0
                found[d].append((log_p[i], value, passed, ids[ends[i] : ends[i + 1]]))
    yield from found


def sample_encodings(
    docs: DataFrame, k: int = SAMPLES, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Up to ``k`` rows for each row of ``docs``: doc_id, sample (1, 2, ...), ids, n_pieces,
    log_prob, perturbed, inclusion, decodes.

    The segmentations of a row are distinct and ordered by ``perturbed``. ``inclusion`` is the
    chance of a segmentation to pass the threshold left by the (k+1)-th best, by which a sample
    without replacement is weighted; it is 1 where the text has no further segmentation.
    ``decodes`` says that decoding gives the text back (its space marks as spaces). Null and
    empty texts have one row with no pieces. Rows of equal id and text give equal samples; a null
    id is a key like any other.
    """
    schema = StructType(
        [StructField("doc_id", docs.schema[id_col].dataType), StructField("sample", IntegerType()),
         StructField("ids", ArrayType(IntegerType(), False)), StructField("n_pieces", IntegerType())]
        + [StructField(c, DoubleType()) for c in ("log_prob", "perturbed", "inclusion")]
        + [StructField("decodes", BooleanType())]
    )

    arrow = to_arrow_schema(schema)
    vocab = Vocabulary.load(model)  # travels with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(vocab)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            # texts become Python strings slice by slice, not all of a batch at once
            for a, part in slices_of(texts, SLICE_CHARS):
                mine = keys.slice(a, len(part))
                rows, found, wanted = [], [], []
                for i, samples in enumerate(_slice_samples(store, mine.to_pylist(), part, k)):
                    for j, (log_p, value, inclusion, ids) in enumerate(samples, 1):
                        rows.append((i, j, len(ids), log_p, value, inclusion))
                        found.append(ids)
                        wanted.append(part[i])
                at, number, n, *scores = zip(*rows, strict=True)
                ids, ends = np.concatenate(found), np.concatenate([[0], np.cumsum(n)])
                same = vocab.all_spell(ids, ends[1:], wanted)
                columns = [mine.take(pa.array(at)), number, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), n, *scores, same]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)],
                    schema=arrow,
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def slices_of(column: pa.Array, budget: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``budget`` characters with the first one's row; nulls as empty."""
    first, run, size = 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if run and size + len(text) > budget:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run
