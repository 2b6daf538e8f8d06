"""Token counts by a compiled finite-state tokenizer.

Two machines are compiled from the tokenizer's file:

1. A deterministic transducer over character classes splits text into pieces as the byte-level pattern does.
   Its transitions emit where pieces begin (before the character read, or before the one ahead of it, since
   white space is decided one character late). The classes of all code points are asked from the library's splitter.
   A text is cut into chunks. Each chunk is run from every state at once, which gives its state map; the maps
   compose by a parallel prefix scan (doubling), which gives each chunk's true first state; a second run from
   there emits the boundaries. So one long text is as parallel as many short ones, in numpy's lanes.
2. A deterministic transducer over bytes (`bpe_machine`), built from the vocabulary's merges, whose transitions emit
   the change in the number of tokens. It begins anew at each boundary. So the map of a chunk that holds a boundary
   is constant in its exit, and affine in its count: tokens after the first boundary, and those that the head of
   the chunk adds to the piece it goes on with. All chunks run at once; then all heads run from their predecessors' exits;
   chunks without any boundary (pieces longer than a chunk) are composed one after another. A text's count
   is a difference of prefix sums of the emissions.

The library encodes nothing here. Special strings are cut out first and count as one token each, which is the library's default.

Defined cases: null and empty texts have no tokens; every whole text is counted; repeated rows give repeated
rows; extra columns pass through unless they bear the output's names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe_machine import HELD, START as PIECE_START, Transducer, merges_of
from siltstone.llm.shared import ship

CHUNK = 256
#: Characters taken at once; bounds the memory of a batch of long texts.
LANES = 1 << 19
LETTER, DIGIT, BLANK, SPACE, QUOTE, MARK, STMD, RV, E, L, HOLD = range(11)
START, IN_L, IN_N, IN_M, Q, Q_RV, Q_L, ONE_B, ONE_S, MANY_B, MANY_S = range(11)
BEFORE, AHEAD = 1, 2  # a piece begins at the character read; at the one ahead of it


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (state, class)."""
    nxt, out = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    letters = (LETTER, STMD, RV, E, L)
    fresh = {DIGIT: IN_N, BLANK: ONE_B, SPACE: ONE_S, QUOTE: Q, MARK: IN_M} | dict.fromkeys(letters, IN_L)
    joined = fresh | {QUOTE: IN_M}  # after a blank that the piece takes along
    for state in range(11):
        nxt[state, HOLD] = state
        for c in range(10):
            to, emit = fresh[c], BEFORE
            white = c in (BLANK, SPACE)
            if state == IN_L and c in letters or state == IN_N and c == DIGIT or state in (IN_M, Q) and c in (MARK, QUOTE):
                to, emit = (IN_M if state == Q else state), 0
            elif state == Q and c == STMD:
                to, emit = START, 0
            elif state == Q and c in (RV, L):
                to, emit = (Q_RV if c == RV else Q_L), 0
            elif state == Q_RV and c == E or state == Q_L and c == L:
                to, emit = START, 0
            elif state in (Q_RV, Q_L):  # no contraction: letters began one character ago
                to, emit = (IN_L, AHEAD) if c in letters else (fresh[c], AHEAD | BEFORE)
            elif state in (ONE_B, ONE_S, MANY_B, MANY_S) and white:
                to, emit = (MANY_B if c == BLANK else MANY_S), 0
            elif state == ONE_B:
                to, emit = joined[c], 0
            elif state == MANY_B:
                to, emit = joined[c], AHEAD
            elif state == MANY_S:
                to, emit = fresh[c], AHEAD | BEFORE
            nxt[state, c], out[state, c] = to, emit
    return nxt, out


NEXT, EMIT = _machine()


def code_point_classes(path: str) -> np.ndarray:
    """Class of every code point, as the library's own splitter sees it."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110000, SPACE, np.uint8)
    out[0x40000:] = MARK  # planes without letters, digits or white space, but for the one asked below
    step = 1 << 14
    for low in (*range(0, 0x40000, step), 0xE0000):
        out[low : low + step] = SPACE
        points = np.array([c for c in range(low, low + step) if not 0xD800 <= c < 0xE000], np.int64)
        if not len(points):
            continue
        # In "!a" + c + "!a" + c ...: c is of a's class if no piece begins at c.
        for probe, kind in (("!a", LETTER), ("!0", DIGIT), ("a!", MARK)):
            begins = {span[0] for _, span in split("".join(probe + chr(c) for c in points.tolist()))}
            own = np.array([3 * i + 2 not in begins for i in range(len(points))])
            out[points[own]] = kind
    out[0xD800:0xE000] = MARK
    for characters, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(c) for c in characters]] = kind
    return out


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """(chunks, length) classes to (chunks, states): the state after the chunk for each state before it."""
    state = np.tile(np.arange(11, dtype=np.uint8), (len(classes), 1))
    flat = NEXT.T.copy().reshape(-1)  # by class, then state
    columns = np.ascontiguousarray(classes.T).astype(np.uint16) * 11
    for column in columns:
        state = flat[column[:, None] + state]
    return state


def entry_states(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True state before each chunk; first marks chunks that begin a text. Inclusive prefix scan by doubling."""
    maps = maps.copy()
    maps[first] = maps[first][:, [START]]  # a text begins in START whatever came before
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1) * 1
        reach *= 2
    before = np.zeros(len(maps), np.uint8)
    before[1:] = maps[:-1, START]
    before[first] = START
    return before


def boundaries(points: np.ndarray, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a piece begins; points: the texts' code points, one after another.
    No text may be empty."""
    chunks = -(-lengths // CHUNK)
    ends = np.cumsum(chunks)
    grid = np.full(int(ends[-1]) * CHUNK, HOLD, np.uint8)
    shift = np.repeat((ends - chunks) * CHUNK - (np.cumsum(lengths) - lengths), lengths)
    where = np.arange(len(points)) + shift
    grid[where] = classes[points]
    grid = grid.reshape(-1, CHUNK)
    first = np.zeros(len(grid), bool)
    first[ends - chunks] = True
    state = entry_states(chunk_maps(grid), first)
    flat_next, flat_emit = NEXT.T.copy().reshape(-1), EMIT.T.copy().reshape(-1)
    columns = np.ascontiguousarray(grid.T).astype(np.uint16) * 11
    emitted = np.empty((CHUNK, len(grid)), np.uint8)
    for j, column in enumerate(columns):
        key = column + state
        emitted[j] = flat_emit[key]
        state = flat_next[key]
    flags = np.ascontiguousarray(emitted.T).reshape(-1)[where]
    begins = (flags & BEFORE) > 0
    begins[:-1] |= (flags[1:] & AHEAD) > 0
    begins[np.cumsum(lengths) - lengths] = True
    return begins


def token_changes(machine: Transducer, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Change in the number of tokens by each byte; begins flags the bytes at which a piece begins (the first one is)."""
    chunks = -(-len(data) // CHUNK)
    grid, fresh = np.zeros(chunks * CHUNK, np.uint8), np.zeros(chunks * CHUNK, bool)
    grid[: len(data)], fresh[: len(data)] = data, begins
    read, fresh = np.ascontiguousarray(grid.reshape(-1, CHUNK).T), np.ascontiguousarray(fresh.reshape(-1, CHUNK).T)
    state, emitted = np.full(chunks, HELD, np.int32), np.empty((CHUNK, chunks), np.int16)
    for j in range(CHUNK):
        state = np.where(fresh[j], np.int32(PIECE_START), state)
        state, emitted[j] = machine.step(state, read[j])
    cut = fresh.any(axis=0)
    head = np.where(cut, fresh.argmax(axis=0), CHUNK)
    head[-1] = min(head[-1], len(data) - (chunks - 1) * CHUNK)
    # Heads of chunks whose predecessor's exit is known, longest first.
    own = np.flatnonzero(head > 0)
    first = own[cut[own - 1]]
    first = first[np.argsort(-head[first], kind="stable")]
    at = state[first - 1]
    for j in range(int(head[first].max(initial=0))):
        n = int(np.count_nonzero(head[first] > j))
        at[:n], emitted[j, first[:n]] = machine.step(at[:n], read[j, first[:n]])
    whole = ~cut[first]
    state[first[whole]] = at[whole]
    for c in own[~cut[own - 1]].tolist():
        after, emitted[0, c] = machine.run(int(state[c - 1]), read[: head[c], c].tobytes())
        if not cut[c]:
            state[c] = after
    return emitted.T.reshape(-1)[: len(data)]


class Counter:
    """Token counts of texts, equal to the length of the library's encoding without added special tokens."""

    def __init__(self, machine: Transducer, classes: np.ndarray, special: list[str]):
        self.machine, self.classes = machine, classes
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _plain(self, texts: list[str]) -> list[int]:
        """Counts of texts that are not empty and hold no special string."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        begins = np.zeros(len(data), bool)
        begins[starts[boundaries(points, lengths, self.classes)]] = True
        changes = token_changes(self.machine, data, begins)
        self.machine.trim()
        return np.add.reduceat(changes.astype(np.int64), starts[np.cumsum(lengths) - lengths]).tolist()

    def __call__(self, texts: list[str | None]) -> list[int]:
        counts = [0] * len(texts)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def flush():
            nonlocal size
            for i, n in zip(owners, self._plain(held) if held else [], strict=True):
                counts[i] += n
            held.clear()
            owners.clear()
            size = 0

        for i, t in enumerate(texts):
            if not t:
                continue
            parts = [t]
            if self.special and self.special.search(t):
                counts[i] += len(self.special.findall(t))
                parts = [p for p in self.special.split(t) if p]
            for p in parts:
                held.append(p)
                owners.append(i)
                size += len(p)
                if size >= LANES:
                    flush()
        flush()
        return counts


@cache
def compiled(path: str) -> tuple[Transducer, np.ndarray, list[str]]:
    """Both machines and the special strings of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file).get("added_tokens", [])]
    return Transducer.compiled(merges_of(path)), code_point_classes(path), special


_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit."""
    spark = df.sparkSession
    ship(spark)
    machines = spark.sparkContext.broadcast(compiled(tokenizer_path))  # some 20 MB, by the vocabulary alone

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # One counter a worker process: what it compiles stays known from task to task.
        counter = _counters.get(tokenizer_path) or _counters.setdefault(tokenizer_path, Counter(*machines.value))
        for texts in batches:
            yield pd.Series(counter([None if t is None else t for t in texts]), dtype="int64")

    out = df.drop("n_bytes", "n_tokens", "over_limit")
    text = F.col(text_col)
    out = out.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return out.withColumn("n_tokens", count(text)).withColumn("over_limit", F.col("n_tokens") > limit)
