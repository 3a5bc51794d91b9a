"""Token counts by compiled transducers, without making the tokens.

Two deterministic transducers work one after the other. The first reads classes of characters and marks
where pre-tokens begin; its chunk maps compose by a parallel prefix scan. The second reads the bytes of a
pre-token; each transition carries by how much the number of tokens of what was read so far changes.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, arrow_schema, pieces, texts
from .vocab import byte_alphabet

#: Characters in a chunk of the first transducer.
CHUNK = 2048
#: Steps for which all entry states of a chunk are followed before those that have met are taken as one.
MEET = 16
#: States of the second transducer, and pre-tokens, that a worker remembers before it begins anew.
STATES, MEMO = 250_000, 800_000

COUNTS = "doc_id long,n_bytes long,n_tokens long"

# Classes of characters.
LETTER, LETTER_STMD, LETTER_RV, LETTER_E, LETTER_L, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, PAD = range(11)
UNKNOWN = 255
# States of the first transducer: what the pre-token that is being read is.
START, WORD, DIGITS, SIGNS, QUOTE, QUOTE_RV, QUOTE_L, CLOSED, SPACE_ONE, WHITE_ONE, SPACE_MORE, WHITE_MORE = range(12)
#: What a transition marks: a pre-token begins at the character read, or at the one before it.
HERE, BEFORE = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by state and class, for the byte-level pattern.

    A suffix after an apostrophe may need two characters to be known ('re), and the last white space of a run
    belongs to what follows if it is a space; so a mark may come one character late.
    """
    letters = (LETTER, LETTER_STMD, LETTER_RV, LETTER_E, LETTER_L)
    first = {**dict.fromkeys(letters, WORD), NUMBER: DIGITS, OTHER: SIGNS, APOSTROPHE: QUOTE, SPACE: SPACE_ONE, WHITE: WHITE_ONE}
    nxt, out = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    run = {WORD: letters, DIGITS: (NUMBER,), SIGNS: (OTHER, APOSTROPHE)}
    for state in range(12):
        nxt[state, PAD] = state
        for c in range(PAD):
            to, mark = first[c], HERE
            if state in run and c in run[state]:
                to, mark = state, 0
            elif state == QUOTE:
                if c == LETTER_STMD:
                    to, mark = CLOSED, 0
                elif c == LETTER_RV:
                    to, mark = QUOTE_RV, 0
                elif c == LETTER_L:
                    to, mark = QUOTE_L, 0
                elif c in run[SIGNS]:
                    to, mark = SIGNS, 0
            elif (state, c) in ((QUOTE_RV, LETTER_E), (QUOTE_L, LETTER_L)):
                to, mark = CLOSED, 0
            elif state in (QUOTE_RV, QUOTE_L):
                to, mark = (WORD, BEFORE) if c in letters else (first[c], BEFORE | HERE)
            elif state in (SPACE_ONE, WHITE_ONE, SPACE_MORE, WHITE_MORE):
                if c in (SPACE, WHITE):
                    to, mark = SPACE_MORE if c == SPACE else WHITE_MORE, 0
                else:
                    to = SIGNS if c == APOSTROPHE and state in (SPACE_ONE, SPACE_MORE) else first[c]
                    mark = {SPACE_ONE: 0, WHITE_ONE: HERE, SPACE_MORE: BEFORE, WHITE_MORE: BEFORE | HERE}[state]
            nxt[state, c], out[state, c] = to, mark
    return nxt, out


@cache
def _classes() -> np.ndarray:
    """The class of every code point; UNKNOWN where it isn't assigned, so that libraries may differ."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": WHITE}
    out = np.array([UNKNOWN if k == "Cn" else kinds.get(k[0], OTHER) for k in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
    out[[*range(0x09, 0x0E), 0x85]] = WHITE
    for text, c in (("stmd", LETTER_STMD), ("rv", LETTER_RV), ("e", LETTER_E), ("l", LETTER_L), ("'", APOSTROPHE), (" ", SPACE)):
        out[[ord(x) for x in text]] = c
    return out


def scan_maps(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state in which each chunk is entered.

    ``maps[k, q]`` is the state after chunk k if it is entered in state q; ``first`` marks the chunks that begin
    a document. Maps are composed with those 1, 2, 4, ... chunks before, so that after log2(n) rounds each holds all from its document on.
    """
    n = len(maps)
    all_, begin = maps.copy(), np.maximum.accumulate(np.where(first, np.arange(n), 0))
    reach = np.arange(n)
    step = 1
    while step < n:
        k = np.flatnonzero(reach > begin)
        if not len(k):
            break
        before = reach[k] - 1
        all_[k] = np.take_along_axis(all_[k], all_[before].astype(np.intp), 1)
        reach[k] = reach[before]
        step *= 2
    entry = np.zeros(n, np.uint8)
    inner = np.flatnonzero(~first)
    entry[inner] = all_[inner - 1, START]
    return entry


class Splitter:
    """Where pre-tokens begin, for many texts at once."""

    def __init__(self, chunk: int = CHUNK):
        self.next, self.out = compile_splitter()
        self.flat_next, self.flat_out = self.next.ravel(), self.out.ravel()
        self.chunk = chunk

    def _run(self, classes: np.ndarray, state: np.ndarray, marks: np.ndarray | None, begin: int, stop: int, rows) -> np.ndarray:
        """Feed steps begin..stop of the chunks ``rows`` (a slice or indices), each in its state; write marks."""
        for t in range(begin, stop):
            at = state.astype(np.intp) * 11
            at += classes[t, rows]
            if marks is not None:
                marks[t, rows] = self.flat_out[at]
            state = self.flat_next[at]
        return state

    def starts(self, chars: list[np.ndarray]) -> list[np.ndarray]:
        """For the code points of each text: the positions at which pre-tokens begin."""
        if not chars:
            return []
        size = self.chunk
        counts = [max(1, -(-len(c) // size)) for c in chars]
        n = sum(counts)
        flat = np.full((n, size), PAD, np.uint8)
        first = np.zeros(n, bool)
        at = 0
        for c, k in zip(chars, counts, strict=True):
            first[at] = True
            flat[at : at + k].reshape(-1)[: len(c)] = _classes()[c]
            at += k
        classes = np.ascontiguousarray(flat.T)
        # All entry states for a few steps; most chunks then are in one state, whatever the entry was.
        meet = min(MEET, size)
        lanes = np.repeat(np.arange(12, dtype=np.uint8)[None], n, 0)
        for t in range(meet):
            lanes = self.flat_next[lanes.astype(np.intp) * 11 + classes[t][:, None]]
        marks = np.zeros((size, n), np.uint8)
        met = (lanes == lanes[:, :1]).all(1)
        maps = np.empty((n, 12), np.uint8)
        state = self._run(classes, lanes[:, 0].copy(), marks, meet, size, slice(None))
        maps[:] = state[:, None]
        for q in range(12) if not met.all() else ():
            rows = np.flatnonzero(~met)
            maps[rows, q] = self._run(classes, lanes[rows, q], None, meet, size, rows)
        entry = scan_maps(maps, first)
        middle = self._run(classes, entry, marks, 0, meet, slice(None))
        if not met.all():
            rows = np.flatnonzero(~met)
            self._run(classes, middle[rows], marks, meet, size, rows)
        marks = np.ascontiguousarray(marks.T).reshape(-1)
        out, at = [], 0
        for c, k in zip(chars, counts, strict=True):
            own = marks[at * size : at * size + len(c)]
            begins = (own & HERE).astype(bool)
            begins[:-1] |= (own[1:] & BEFORE).astype(bool)
            if len(c):
                begins[0] = True
                last = maps[at + k - 1, 0] if met[at + k - 1] else maps[at + k - 1, entry[at + k - 1]]
                if last in (QUOTE_RV, QUOTE_L):
                    begins[-1] = True
            out.append(np.flatnonzero(begins))
            at += k
        return out


class MergeTransducer:
    """Counts the tokens of a byte string from left to right.

    Every prefix has one encoding, and the encoding without its last token is that of a shorter prefix. So the last token
    of a prefix is the one that ends there and is compatible with the last token before it: encoding the two
    together gives just these two. A state holds, for each place from which a token could still grow, the
    node of the token trie, the last token there, and how many fewer tokens there were. States and
    transitions are compiled when first reached.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        spell = lambda s: b"".join(byte[c] for c in s)
        self.ids = {spell(s): i for s, i in model["vocab"].items() if all(c in byte for c in s)}
        self.text = {i: b for b, i in self.ids.items()}
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            left, right = map(spell, m.split(" ") if isinstance(m, str) else m)
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for b, i in self.ids.items():
            node = 0
            for x in b:
                if x not in self.child[node]:
                    self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][x]
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        begin = ((0, -1, 0),)
        self.state = {begin: 0}
        self.items = [begin]
        self.go: list[dict[int, tuple[int, int]]] = [{}]

    def encode(self, piece: bytes) -> list[int]:
        """The merges carried out, as a check and for compatibility."""
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        none = (len(self.merges), -1)
        while len(ids) > 1:
            best, i = min((self.merges.get((a, b), none)[0], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if best == none[0]:
                break
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _fit(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (a, b) not in self.fits:
            if len(self.fits) > 4 * MEMO:
                self.fits.clear()
            self.fits[a, b] = (a, b) not in self.merges and self.encode(self.text[a] + self.text[b]) == [a, b]
        return self.fits[a, b]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        grown, last, delta = [], -1, 0
        for node, before, fewer in self.items[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            grown.append((to, before, fewer))
            t = self.token[to]
            if last < 0 and t >= 0 and self._fit(before, t):
                last, delta = t, 1 - fewer
        items = (*((to, before, fewer + delta) for to, before, fewer in grown if self.child[to]), (0, last, 0))
        if items not in self.state:
            self.state[items] = len(self.items)
            self.items.append(items)
            self.go.append({})
        self.go[state][byte] = got = self.state[items], delta
        return got

    def count(self, piece: bytes) -> int:
        if len(self.items) > STATES:
            self._reset()
        state = total = 0
        go = self.go
        for b in piece:
            step = go[state].get(b)
            state, delta = step if step is not None else self._compile(state, b)
            total += delta
        return total


class Counter:
    """Counts tokens as the library would for the text alone: special strings are one token each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path}: not a byte-level tokenizer without a normaliser")
        self.splitter, self.merges = Splitter(), MergeTransducer(path)
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.memo = Memo(lambda pre: self.merges.count(pre.encode()), MEMO)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. Code points that aren't assigned are left to the library."""
        out, parts = [0] * len(texts), []
        for i, t in enumerate(texts):
            own = [t]
            if self.special is not None and self.special.search(t):
                own = self.special.split(t)
                out[i] = len(own) - 1
            for p in own:
                chars = np.frombuffer(p.encode("utf-32-le"), "<u4")
                if not p.isascii() and (_classes()[chars] == UNKNOWN).any():
                    out[i] += len(self.library.encode(p, add_special_tokens=False).ids)
                else:
                    parts.append((i, p, chars))
        for (i, p, _), s in zip(parts, self.splitter.starts([c for _, _, c in parts]), strict=True):
            at = s.tolist() or [0]
            out[i] += sum(map(self.memo.__getitem__, [p[a:b] for a, b in zip(at, [*at[1:], len(p)], strict=True) if a < b]))
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def _count(path: str):
    schema = arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in pieces(batches):
            got = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t.encode()) for t in got], pa.int64()), pa.array(own.counts(got), pa.int64())], schema=schema)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The UTF-8 bytes and tokens of every text: doc_id, n_bytes, n_tokens.

    A null or empty text has 0 of both. Repeated rows give repeated results; an empty table gives no rows.
    Columns other than doc_id and text don't matter. One pass without a shuffle; a long text is many
    chunks of one size, so memory follows the bytes at hand, not their division into texts.
    """
    return texts(docs).mapInArrow(_count(tokenizer_path), COUNTS)
