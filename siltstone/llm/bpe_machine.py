"""Byte-pair encoding compiled into a deterministic transducer whose transitions carry token counts.

Every prefix of an encoding is the encoding of what it spells. So the encoding of a piece's first n bytes ends in one
token t, before which stands the encoding of the n - |t| bytes before; t is the one token for which the last token of
that shorter prefix and t may stand side by side (`apart`). What the further bytes can ask for is therefore known from

    the starts j at which a token may have begun that is not finished yet, and for each of them the node of the
    vocabulary's tree that the bytes from j on have reached, the last token before j, and how many tokens fewer
    (or more) the first j bytes have than all bytes so far.

That is a state. A transition reads a byte and emits the change in the number of tokens. States and transitions are
compiled from the vocabulary's merges alone: those of all strings that begin a token ahead of time (`base`), others
when a text first needs them, as a lazy automaton does; these are dropped when they become too many. Transitions lie in an
open hash table of numpy arrays, so that many texts step at once.
"""

from __future__ import annotations

import json

import numpy as np

START, HELD = 0, 1
#: States beyond which the ones compiled on demand are dropped (some 200 bytes each).
MAX_STATES = 600_000
_SHIFT_LAST, _SHIFT_NODE, _LEVEL = 12, 32, 2048
_FIB = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary file writes for each byte: printable Latin-1 stands for itself, the
    other bytes get the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merges_of(path: str) -> list[tuple[bytes, bytes]]:
    """The merges of a byte-level vocabulary file, in order."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or whole.get("normalizer"):
        raise ValueError("only plain byte-level vocabularies are compiled")
    to_byte = byte_alphabet()
    spelled = lambda s: bytes(to_byte[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return [(spelled(a), spelled(b)) for a, b in pairs]


class Vocabulary:
    """Tokens numbered in order of creation: 0 to 255 are the bytes, 256 + r is made by merge r."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        number = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        for a, b in merges:
            x, y, own = number[a], number[b], len(self.left)
            self.left.append(x)
            self.right.append(y)
            self.pair[x << 20 | y] = own
            number.setdefault(a + b, own)
        sound = [True] * 256
        for t in range(256, len(self.left)):
            x, y = self.left[t], self.right[t]
            sound.append(sound[x] and sound[y] and self.apart(x, y, t))
        # The tree of all tokens' bytes: child[node << 8 | byte], token[node] (-1: none), open[node]: has children.
        self.child, self.token, self.open = {}, [-1], [False]
        for text, t in number.items():
            node = 0
            for b in text:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.open[node] = True
                    self.token.append(-1)
                    self.open.append(False)
                node = self.child[key]
            if sound[t]:  # a token whose own bytes are encoded otherwise never occurs
                self.token[node] = t
        self.texts = list(number)

    def apart(self, a: int, b: int, limit: int = 1 << 30) -> bool:
        """Do tokens a and b, side by side, stay so? Undo their merges from the latest to the earliest: at each moment
        the two that stand at the border may be merged only by a rule that comes later than what is undone."""
        pair, left, right = self.pair, self.left, self.right
        while True:
            made = pair.get(a << 20 | b)
            if made is not None and made < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, right[a]  # of equal rules the left place comes first, so the border's must be earlier
            else:
                limit, b = b + 1, left[b]


class Transducer:
    """State 0 is a piece's beginning; state 1 is held, whatever is read."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.signatures: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.fitting: dict[int, bool] = {}
        self._room(1 << 12)
        self._number([0])  # root of the tree, no token before, level
        self.signatures.append(b"")
        for b in range(256):
            self._put(HELD << 8 | b, HELD, 0)
        self.base = None

    @classmethod
    def compiled(cls, merges: list[tuple[bytes, bytes]]) -> Transducer:
        """With the transitions of everything that begins a token."""
        out = cls(Vocabulary(merges))
        for text in out.vocabulary.texts:
            out.run(START, text)
        out.freeze()
        return out

    def freeze(self) -> None:
        """What is compiled now is kept for good."""
        self.base = (self.keys.copy(), self.states.copy(), self.emits.copy(), self.used, len(self.signatures))

    def trim(self) -> None:
        """Back to the base if there are too many states."""
        if self.base is not None and len(self.signatures) > max(MAX_STATES, 2 * self.base[4]):
            keys, states, emits, self.used, n = self.base
            self.keys, self.states, self.emits = keys.copy(), states.copy(), emits.copy()
            self.shift = np.uint64(64 - (len(keys).bit_length() - 1))
            for s in self.signatures[n:]:
                self.numbers.pop(s, None)
            del self.signatures[n:]
            self.fitting.clear()

    # --- table of transitions ----------------------------------------------------------------------------------------
    def _room(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.states, self.emits = np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.shift, self.used = np.uint64(64 - (size.bit_length() - 1)), 0

    def _put(self, key: int, state: int, emit: int) -> None:
        if 2 * self.used >= len(self.keys):
            own = np.flatnonzero(self.keys >= 0)
            old = (self.keys[own], self.states[own], self.emits[own])
            self._room(2 * len(self.keys))
            self.used = len(own)
            left = np.arange(len(own))
            at = self._home(old[0])
            while len(left):  # all that find a free place take it; of several, the last one written
                free = self.keys[at] < 0
                self.keys[at[free]] = old[0][left[free]]
                done = self.keys[at] == old[0][left]
                self.states[at[done]], self.emits[at[done]] = old[1][left[done]], old[2][left[done]]
                left, at = left[~done], (at[~done] + 1) & (len(self.keys) - 1)
        mask, at = len(self.keys) - 1, ((key * int(_FIB)) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[at] >= 0:
            at = (at + 1) & mask
        self.keys[at], self.states[at], self.emits[at] = key, state, emit
        self.used += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FIB) >> self.shift).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys; and which keys have none."""
        at = self._home(keys)
        bad = np.flatnonzero(self.keys[at] != keys)
        missing = [bad[:0]]
        mask = len(self.keys) - 1
        while len(bad):
            empty = self.keys[at[bad]] < 0
            missing.append(bad[empty])
            bad = bad[~empty]
            at[bad] = (at[bad] + 1) & mask
            bad = bad[self.keys[at[bad]] != keys[bad]]
        return at, np.concatenate(missing)

    def step(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emissions of many lanes."""
        keys = states.astype(np.int64) << 8 | read
        at, missing = self._places(keys)
        if len(missing):
            for key in np.unique(keys[missing]).tolist():
                self._compile(key >> 8, key & 255)
            at, _ = self._places(keys)
        return self.states[at], self.emits[at]

    def _find(self, key: int) -> int:
        mask, at = len(self.keys) - 1, ((key * int(_FIB)) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (k := self.keys[at]) != key:
            if k < 0:
                self._compile(key >> 8, key & 255)
                return self._find(key)
            at = (at + 1) & mask
        return at

    def run(self, state: int, text: bytes) -> tuple[int, int]:
        """State after a text and its tokens, byte by byte."""
        total = 0
        for b in text:
            at = self._find(state << 8 | b)
            state, total = int(self.states[at]), total + int(self.emits[at])
        return state, total

    # --- compilation -------------------------------------------------------------------------------------------------
    def _number(self, entries: list[int]) -> int:
        signature = np.array(entries, np.int64).tobytes()
        found = self.numbers.get(signature)
        if found is None:
            found = self.numbers[signature] = len(self.signatures)
            self.signatures.append(signature)
        return found

    def _compile(self, state: int, read: int) -> None:
        v = self.vocabulary
        live, own = [], None
        for entry in np.frombuffer(self.signatures[state], np.int64).tolist():
            # An entry: node of the tree, last token + 1 (0: none), tokens less than now (+ _LEVEL; the root's own entry is 0).
            node, last = entry >> _SHIFT_NODE, entry >> _SHIFT_LAST & 0xFFFFF
            level = (entry & 0xFFF) - _LEVEL if entry & 0xFFF else 0
            node = v.child.get(node << 8 | read)
            if node is None:
                continue
            t = v.token[node]
            if own is None and t >= 0:
                pair = last << 20 | t
                if last:
                    fits = self.fitting.get(pair)
                    if fits is None:
                        fits = self.fitting[pair] = v.apart(last - 1, t)
                else:
                    fits = True
                if fits:
                    own = (t, level + 1)
            if v.open[node]:
                live.append((node, last, level))
        token, emit = own
        entries = [(token + 1) << _SHIFT_LAST]
        entries += [node << _SHIFT_NODE | last << _SHIFT_LAST | (level - emit + _LEVEL) for node, last, level in live]
        self._put(state << 8 | read, self._number(entries), emit)
