"""What the parsers share."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: Fixed values.
PY_SKIPPED = " pass # 구현부 생략"
C_SKIPPED = "{ /* 구현부 생략 */ }"
LANGUAGES = {".py": "python", ".cs": "c_sharp", ".xaml": "xaml", ".cpp": "cpp", ".h": "cpp", ".hpp": "cpp", ".c": "cpp"}
_LONG_BLANKS = re.compile(r"\s{9,}")
_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)


@dataclass
class Chunk:
    qualified_name: str
    name: str
    type: str
    content: str
    filepath: str
    start_line: int
    language: str
    module_path: str
    calls: list[str] = field(default_factory=list)
    imports: dict[str, str] = field(default_factory=dict)
    includes: list[str] = field(default_factory=list)
    status: str = "ok"


def normal(path: str) -> str:
    parts = path.split("/")
    return "/".join(p for i, p in enumerate(parts) if not i or p != parts[i - 1])


def parent(path: str) -> str:
    return path.rpartition("/")[0] or "."


def base(path: str) -> str:
    return path.rpartition("/")[2]


def stem(path: str) -> str:
    name = base(path)
    return name.rpartition(".")[0] or name


def blanked(code: str) -> str:
    """Code of the same length with strings and comments blanked, so that braces in them do not count."""
    return _NOISE.sub(lambda m: "\n".join(" " * len(line) for line in m[0].split("\n")), code)


class Squeezed:
    """Blanked code whose long blanks, which comments leave, are cut to one (after a line's end, if they hold one): the patterns
    take blanks of any length for the same, and go over them many times."""

    def __init__(self, code: str):
        out, last, lost, self.whole = [], 0, 0, len(code)
        self._ends, self._lost = [], [0]
        for m in _LONG_BLANKS.finditer(code):
            short = "\n " if "\n" in m[0] else " "
            out += [code[last : m.start()], short]
            last, lost = m.end(), lost + len(m[0]) - len(short)
            self._ends.append(last - lost)
            self._lost.append(lost)
        self.code = "".join(out) + code[last:]

    def at(self, place: int) -> int:
        """The place of a character in the code as it was."""
        return place + self._lost[bisect_right(self._ends, place)]

    def after(self, place: int) -> int:
        """The place that follows the character before `place`; the end of the code for its end."""
        return self.at(place - 1) + 1 if 0 < place < len(self.code) else self.whole if place else 0


def block_end(code: str, brace: int) -> int:
    """Position after the brace that closes the one at `brace`; the end of the code if none does."""
    depth = 0
    for m in re.compile("[{}]").finditer(code, brace):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def line_of(code: str, at: int) -> int:
    return code.count("\n", 0, at) + 1


def hollow(code: str, bodies: list[tuple[int, int]], start: int, filler: str) -> str:
    """code (which begins at start) with its outermost bodies replaced by filler."""
    out, at = [], start
    for a, b in sorted(bodies):
        if a >= at:
            out += [code[at - start : a - start], filler]
            at = b
    return "".join(out) + code[at - start :]


def file_chunk(path: str, text: str, language: str, qualified_name: str, module: str, chunks: list[Chunk], **more) -> Chunk:
    structured = any(c.type in ("class", "method") for c in chunks)
    content = f"File: {base(path)}\nPath: {normal(path)}\nSummary: " if structured else text
    return Chunk(qualified_name, base(path), "file", content, normal(path), 1, language, module, **more)
