"""Token counts by compiled finite-state transducers.

Two deterministic transducers reproduce a byte-level BPE tokenizer:

* The splitter reads symbols (character classes, with a look-ahead of at most two
  characters folded in) and marks each transition that begins a new pre-token. A stream of
  documents is cut into equal chunks; every chunk is run from all states at once, which
  gives its state map, the maps are composed by a parallel prefix scan, and a second run
  from the then known states yields the marks.
* The merger reads the stream's bytes and annotates each transition with the tokens that it emits (fewer than none where
  bytes join what were several). A new pre-token leads back to the first state. A state is all of a pre-token's prefix that can still matter: its
  longest ending that some token begins with, and at each place of that the last token of the encoding and how many
  tokens it lacks. Transitions are compiled as they are needed: the last token of the encoding of prefix+byte is the longest vocabulary suffix that
  may follow what stands before it, and a pair may follow one another if the pair's own encoding is that pair. Chunks run side by side: the first run
  starts in an unknown state and gives each chunk's map, which is the same end state whatever the start, because a chunk is longer than the pre-tokens
  kept in it and so begins one, and the tokens emitted after that. The maps compose by a prefix scan, which gives every chunk its true
  start, and a second run counts what each emits before its first pre-token. Sums of the counts between a text's
  ends are its tokens. Pre-tokens longer than LONG bytes are run alone, by the same rule without kept states.

Defined results: null and empty texts have 0 tokens; special strings inside a text are one
token each, as the library's default has it; nothing is truncated, and very long texts and words are counted whole. Repeated rows and empty
tables need no care: each row is counted on its own. Columns beside doc_id and text never
enter.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strataweave.llm.common import blocks, table

# Symbols. A2/A3: an apostrophe that begins a contraction of one or two letters. GLUE and ALONE: a
# space and another white space before a non-space; WHITE: white space before white space or the end.
LETTER, NUMBER, OTHER, A2, A3, GLUE, ALONE, WHITE, END = range(9)
# States: at a token's beginning, in a run of letters, numbers, others or white space, after a space
# that joins what follows, and with one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, JOIN, WHITES, ONE, TWO = range(8)
STATES = 300_000  # of the merger (about 500 bytes each); the block of texts after one that reaches it begins anew
SHIFT = 1 << 15  # keeps packed numbers of emitted tokens above zero
LONG, LANE = 64, 128  # bytes: of the longest pre-token whose states are kept, and of a chunk of the merger
UNKNOWN = -1  # the state of a chunk before its first pre-token begins


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begins-a-token, both by [state, symbol]."""
    to, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    runs = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}
    for state in range(8):
        for symbol, run in runs.items():
            to[state, symbol], begins[state, symbol] = run, state not in (run, JOIN)
        for symbol, rest in ((A2, ONE), (A3, TWO)):
            inside = state in (OTHERS, JOIN)
            to[state, symbol], begins[state, symbol] = (OTHERS, False) if inside and state == OTHERS else (OTHERS if inside else rest, not inside)
        to[state, GLUE], to[state, ALONE], to[state, END] = JOIN, FRESH, FRESH
        to[state, WHITE], begins[state, WHITE] = WHITES, state != WHITES
    to[ONE, LETTER], begins[ONE, LETTER] = FRESH, False
    to[TWO, LETTER], begins[TWO, LETTER] = ONE, False
    return to, begins


@functools.cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE by code point."""
    white = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kinds = {"L": LETTER, "N": NUMBER}
    of = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    of[list(white)] = WHITE
    return of


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The splitter's symbols of a stream of code points; `ends` are the places of separators."""
    of = _classes()[points]
    of[ends] = END
    ahead = np.append(of[1:], END)
    white = of == WHITE
    solid = white & (ahead != WHITE) & (ahead != END)
    of[solid] = np.where(points[solid] == 32, GLUE, ALONE)
    at = np.flatnonzero((points == 39) & (of == OTHER))
    if len(at):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[at + 1], padded[at + 2]
        of[at[np.isin(one, [ord(c) for c in "stmd"])]] = A2
        for pair in ("re", "ve", "ll"):
            of[at[(one == ord(pair[0])) & (two == ord(pair[1]))]] = A3
    return of


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps [chunk, state], in log2(chunks) steps."""
    step, maps = 1, maps.copy()
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def begins(stream: np.ndarray, chunk: int = 96) -> np.ndarray:
    """For each symbol whether it begins a pre-token."""
    to, marks = _splitter()
    size = len(stream)
    lanes = -(-size // chunk)
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[:size] = stream
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    flat, flags = to.ravel(), marks.ravel()
    state = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)
    for column in columns:
        state = flat[state * np.uint8(9) + column]
    through = compose(state.T)
    now = np.concatenate([[FRESH], through[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((chunk, lanes), bool)
    for i, column in enumerate(columns):
        at = now * np.uint8(9) + column
        out[i], now = flags[at], flat[at]
    return out.T.ravel()[:size]


class Moves:
    """(state, byte) -> (state, tokens emitted) in one number: open addressing in arrays, so that many are looked up at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def add(self, key: int, value: int) -> None:
        if 2 * self.used >= len(self.keys):
            full = np.flatnonzero(self.keys >= 0)
            keys, values = self.keys[full], self.values[full]
            self.__init__(self.bits + 2)
            for k, v in zip(keys.tolist(), values.tolist(), strict=True):
                self.add(k, v)
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & ((1 << self.bits) - 1)
        self.keys[slot], self.values[slot] = key, value
        self.used += 1


class Merger:
    """The merging transducer, compiled as it is needed."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.letter = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = {t: bytes(self.letter[c] for c in t) for t in vocabulary if all(c in self.letter for c in t)}
        self.ids = {b: vocabulary[t] for t, b in raw.items()}
        self.text = {i: b for b, i in self.ids.items()}
        self.rank = {(vocabulary[a], vocabulary[b]): (n, vocabulary[a + b]) for n, (a, b) in enumerate(merges)}
        self.split = {merged: (n, *pair) for pair, (n, merged) in self.rank.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.begun = {b[:i] for b in self.ids for i in range(len(b))}  # what some token begins with
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        # A state: the ending that a token may begin with, and from its end to its beginning (last token, tokens less than at the end).
        self.moves = Moves()
        self.states: list[tuple] = [(b"", ((-1, 0),))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}

    def encode(self, raw: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until none is left."""
        out = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
        while len(out) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            pair, merged, i = (out[best[1]], out[best[1] + 1]), [], 0
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == pair:
                    merged.append(self.rank[pair][1])
                    i += 2
                else:
                    merged.append(out[i])
                    i += 1
            out = merged
        return out

    @functools.cache  # noqa: B019  one merger a vocabulary and worker, as many entries as tokens
    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at an edge of a token while it is merged, each with the rank of the merge that ends it."""
        out = [(token, len(self.rank))]
        while token in self.split:
            n, *parts = self.split[token]
            token = parts[side]
            out.append((token, n))
        return out

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a: the encoding of both together is these two.

        It is unless a token at a's right edge and one at b's left edge merge while both are there; of equal merges the left one goes first.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * STATES:
                self.pairs.clear()
            known = a < 0 or not any(
                (found := self.rank.get((x, y))) and found[0] < x_ends and found[0] <= y_ends for x, x_ends in self._edge(a, 1) for y, y_ends in self._edge(b, 0)
            )
            self.pairs[key] = known
        return known

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a byte, entered: state << 16 | tokens emitted + SHIFT."""
        ending, places = self.states[state]
        raw = ending + bytes([byte])
        best = None
        for size in range(len(raw), 0, -1):
            token = self.ids.get(raw[-size:])
            if token is not None and self.follows(places[size - 1][0], token):
                best = token, 1 - places[size - 1][1]  # tokens more than before the byte
                break
        if best is None:
            raise ValueError("the vocabulary lacks a single byte")
        token, emitted = best
        ending = raw
        while ending not in self.begun:
            ending = ending[1:]
        key = ending, ((token, 0), *((t, less + emitted) for t, less in places[: len(ending)]))
        new = self.numbers.get(key)
        if new is None:
            new = self.numbers[key] = len(self.states)
            self.states.append(key)
        value = new << 16 | emitted + SHIFT
        self.moves.add(state << 8 | byte, value)
        return value

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that bytes lead to, and the tokens emitted."""
        keys = states << 8 | bytes_
        out = self.moves.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            some, back = np.unique(keys[new], return_inverse=True)
            out[new] = np.array([self._compile(k >> 8, k & 255) for k in some.tolist()], np.int64)[back]
        return out >> 16, (out & 0xFFFF) - SHIFT

    def alone(self, raw: bytes) -> int:
        """The number of tokens of a long pre-token, by the same rule; no state is kept."""
        last, count = [-1], [0]
        for end in range(len(raw)):
            for size in range(min(end + 1, self.longest), 0, -1):
                token = self.ids.get(raw[end + 1 - size : end + 1])
                if token is not None and self.follows(last[end + 1 - size], token):
                    last.append(token)
                    count.append(count[end + 1 - size] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return count[-1]

    def emitted(self, raw: np.ndarray, begin: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Tokens that each byte of a stream emits; `begin`: where pre-tokens begin, at most `lane` bytes apart."""
        if len(self.states) > STATES:
            self.clear()
        lanes = -(-len(raw) // lane)
        bytes_, marks = np.zeros(lanes * lane, np.int64), np.ones(lanes * lane, bool)
        bytes_[: len(raw)], marks[: len(raw)] = raw, begin
        bytes_, marks = (np.ascontiguousarray(x.reshape(lanes, lane).T) for x in (bytes_, marks))
        out = np.zeros((lane, lanes), np.int32)
        state = np.full(lanes, UNKNOWN, np.int64)
        for i in range(lane):  # each chunk's map: nothing is known before its first pre-token
            state[marks[i]] = 0
            known = np.flatnonzero(state >= 0) if i < LONG else slice(None)
            state[known], out[i][known] = self.step(state[known], bytes_[i][known])
        # A map's end state does not depend on its start, so the scan's product is the last map's; the first chunk begins at 0.
        state = np.concatenate([[0], state[:-1]])
        live = np.flatnonzero(~marks[0])
        for i in range(lane):  # what stands before a chunk's first pre-token
            if not len(live):
                break
            state[live], out[i][live] = self.step(state[live], bytes_[i][live])
            if i + 1 < lane:
                live = live[~marks[i + 1][live]]
        return out.T.ravel()[: len(raw)]


@functools.lru_cache(maxsize=2)
def _compiled(path: str) -> tuple[Merger, tuple[str, ...]]:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Merger(spec["model"]["vocab"], merges), tuple(t["content"] for t in spec["added_tokens"])


def count_texts(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text."""
    merger, special = _compiled(path)
    counts = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        pieces = [text]
        for mark in special:
            if mark in text:
                pieces = [y for x in pieces for y in x.split(mark)]
        counts[i] += len(pieces) - 1
        for piece in pieces:
            if piece:
                parts.append(piece)
                owner.append(i)
    if not parts:
        return counts.tolist()
    stream = "\n".join(parts) + "\n"
    points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    marks = np.flatnonzero(begins(symbols(points, ends)))
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])  # of each character among the bytes
    data = stream.encode()
    raw = np.frombuffer(data, np.uint8)
    begin = np.zeros(len(raw), bool)
    begin[place[marks]] = True
    edges = np.append(place[marks], len(raw))
    long_ = np.flatnonzero(np.diff(edges) > LONG)
    for i in long_.tolist():
        begin[edges[i] : edges[i + 1]] = True  # its bytes go through as if alone, and are counted anew below
    each = merger.emitted(raw, begin).astype(np.int64)
    for i in long_.tolist():
        each[edges[i] : edges[i + 1]] = 0
        each[edges[i]] = merger.alone(data[edges[i] : edges[i + 1]])
    before = np.concatenate([[0], np.cumsum(each)])
    stop = place[ends]
    start = np.concatenate([[0], stop[:-1] + 1])  # the separators are left out
    np.add.at(counts, owner, before[stop] - before[start])
    return counts.tolist()


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (doc_id, text).

    `vocabulary` is the tokenizer's JSON file, which every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [x or "" for x in block.column("text").to_pylist()]
            tokens = pa.array(count_texts(texts, vocabulary), pa.int64())
            size = pa.array([len(x.encode()) for x in texts], pa.int64())
            over = pa.array([x > limit for x in tokens.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), size, tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
