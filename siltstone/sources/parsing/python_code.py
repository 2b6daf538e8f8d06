"""Python files."""

from __future__ import annotations

import ast
import re

from siltstone.functions.text import RESERVED_WORDS, python_module
from siltstone.sources.parsing.common import PY_SKIPPED, Chunk, file_chunk, normal

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def valid_call(name: str) -> bool:
    return 2 <= len(name) <= 50 and name.isascii() and name.replace(".", "_").isidentifier() and not name.startswith(".") and name.strip("_.") != "" and name not in RESERVED_WORDS


def _dotted(node: ast.expr) -> str | None:
    """Text of a name or of a whole attribute access."""
    if isinstance(node, ast.Name):
        return node.id
    return ast.unparse(node) if isinstance(node, ast.Attribute) else None


def calls_of(node: ast.AST, skipped: frozenset[int] = frozenset()) -> list[str]:
    """Sorted distinct names that are called in a definition's own text, of which its decorators are no part; chains count as
    a whole. skipped: ids of nodes that are left out."""
    outside = {id(x) for d in getattr(node, "decorator_list", ()) for x in ast.walk(d)} | skipped
    found = {_dotted(n.func) for n in ast.walk(node) if isinstance(n, ast.Call) and id(n) not in outside}
    return sorted(n for n in found if n and valid_call(n))


def imports_of(tree: ast.AST) -> dict[str, str]:
    """Local name to full name."""
    out = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out |= {a.asname or a.name: a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            out |= {a.asname or a.name: f"{n.module}.{a.name}" if n.module else a.name for a in n.names}
    return out


class _Offsets:
    """Character offsets of the syntax tree's positions (which count bytes within a line)."""

    def __init__(self, text: str):
        self.lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text)  # the lines that the parser counts, no others
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))

    def __call__(self, line: int, column: int) -> int:
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:column].decode(errors="ignore"))


def _bodies(node: ast.AST, at: _Offsets) -> list[tuple[int, int]]:
    return [(at(n.body[0].lineno, n.body[0].col_offset), at(n.end_lineno, n.end_col_offset)) for n in ast.walk(node) if isinstance(n, _DEFS)]


def parse(path: str, text: str, root: str = "") -> list[Chunk]:
    module = python_module(path, root)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        out = file_chunk(path, text, "python", module + ".py", module, [])
        out.status = "syntax error"
        return [out]
    at, chunks, imports = _Offsets(text), [], imports_of(tree)

    def walk(node: ast.AST, names: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (*_DEFS, ast.ClassDef)):
                walk(child, names)
                continue
            start, end = at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)
            code, kind, skipped = text[start:end], "function", frozenset()
            if isinstance(child, ast.ClassDef):
                kind, kept = "class", []
                for a, b in sorted(_bodies(child, at)):
                    if not kept or a >= kept[-1][1]:
                        kept.append((a, b))
                skipped = frozenset(id(x) for f in ast.walk(child) if isinstance(f, _DEFS) for y in f.body for x in ast.walk(y))
                out, p = [], start
                for a, b in kept:
                    out += [text[p:a].rstrip(), PY_SKIPPED]
                    p = b
                code = "".join(out) + text[p:end]
            full = ".".join((module, *names, child.name))
            chunks.append(Chunk(full, child.name, kind, code, normal(path), child.lineno, "python", module, calls_of(child, skipped), imports))
            walk(child, (*names, child.name))

    walk(tree, ())
    return [*chunks, file_chunk(path, text, "python", module + ".py", module, chunks, imports=imports)]
