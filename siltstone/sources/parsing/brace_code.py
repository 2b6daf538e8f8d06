"""C# and C++ files, by matching braces in code whose strings and comments are blanked."""

from __future__ import annotations

import re

from siltstone.functions.text import INCLUDE_PATTERN, NAMESPACE_PATTERN
from siltstone.sources.parsing.common import C_SKIPPED, Chunk, Squeezed, base, blanked, block_end, file_chunk, hollow, line_of, normal, parent, stem

#: Fixed values.
NOT_METHODS = ("if", "for", "while", "switch", "return", "else", "catch")
_NOT_CALLS = {*NOT_METHODS, "using", "lock", "foreach", "fixed", "when", "sizeof", "typeof", "nameof", "default", "checked", "unchecked", "base", "this", "new", "do", "case", "throw", "await", "delete", "alignof", "decltype", "static_assert", "noexcept"}
#: Words after which a name with brackets is an expression, not a declaration.
_BEFORE_CALLS = {"return", "new", "await", "throw", "else", "do", "case", "in", "yield", "goto", "delete", "and", "or", "not", "is", "as", "when", "co_await", "co_return", "co_yield"}
_NAMESPACE = re.compile(r"\bnamespace\s+([\w.:]+)\s*([{;])?")
_CS_TYPE = re.compile(r"(?:\[[^\[\]]*\]\s*)*(?:\b(?:public|private|protected|internal|static|abstract|sealed|partial|unsafe|new|file|readonly|ref)\s+)*\b(class|struct|interface|record(?:\s+(?:class|struct))?)\s+(\w+)[^;{}()]*(?:\([^()]*\)[^;{}()]*)?\{")
_CPP_TYPE = re.compile(r"(?<!enum )\b(?:(ref)\s+)?(?:class|struct)\s+(\w+)[^;{}()]*\{")
_WORDS = r"((?:[\w<>\[\],.?*&^:~]++\s++){0,12})"  # what a word or its blanks would give back cannot go on
_PARAMETERS = r"\(([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*)\)"
_METHOD = re.compile(rf"(?:^|(?<=[;{{}}\]\n:>]))[^\S\n]*{_WORDS}[*&^]*(~?\w+)\s*(?:<[^<>]*>)?\s*{_PARAMETERS}\s*+((?:const|noexcept|override|final|where[^{{;]*|->\s*[\w:<>]+|:[^{{;]*(?:(?<=\w)\{{[^{{}}]*\}}[^{{;]*)*|\s)*)\{{")
_BODILESS = re.compile(rf"(?:^|(?<=[;{{}}\]\n:]))[^\S\n]*{_WORDS}[*&^]*(~?\w+)\s*(?:<[^<>]*>)?\s*{_PARAMETERS}\s*(?:const|noexcept|override|final|where[^{{;]*|=\s*(?:0|default|delete)|\s)*(?:;|=>)")
_PROPERTY = re.compile(r"(?:^|[;{}\]\n])[^\S\n]*(?:[\w<>\[\],.?]++\s++){1,12}(\w+)\s*(?:\{\s*(?:\w+\s+)*(?:get|set|init)\b|=>)")
_CALL = re.compile(r"((?:\w+::)*)(?:(\.|->)\s*)?(\b[A-Za-z_]\w*)\s*(?:<[\w, ]*>)?\s*\(")
_NEW_ARGUMENTS = re.compile(r"\bnew\s+[\w.<>]+\s*\(([^()]*)\)")
_OUTSIDE = re.compile(r"(?:^|\n|[;}])[^\n;{}()]*?\b(\w+)::(~?\w+)\s*\([^)]*\)\s*(?:const\s*)?(?::[^{;]*)?\{")
_INITIALIZED = re.compile(r"(?:^|,)\s*[:\s]*([\w:<>]+)\s*$")
_INCLUDE = re.compile(INCLUDE_PATTERN)


def csharp_calls(code: str) -> list[str]:
    """Invoked names (the last part of x.m), and identifiers given to constructors, as delegates are. code: without_heads()."""
    found = {m[3] for m in _CALL.finditer(code) if m[3] not in _NOT_CALLS and not re.search(r"\bnew\s+[\w.]*$", code[max(0, m.start(3) - 80) : m.start(3)])}
    for m in _NEW_ARGUMENTS.finditer(code):
        found |= {a.strip() for a in m[1].split(",") if re.fullmatch(r"\s*[A-Za-z_]\w*\s*", a) and a.strip() not in ("this", "null", "true", "false")}
    return sorted(found)


def cpp_calls(code: str) -> list[str]:
    """f of f(), m of x.m() and x->m(), A::b of A::b(). code: without_heads()."""
    return sorted({m[3] if m[2] else m[1] + m[3] for m in _CALL.finditer(code) if m[3] not in _NOT_CALLS})


def _is_declaration(words: str, name: str, bodiless: bool) -> bool:
    before = words.split()
    if name in _NOT_CALLS or (before and before[-1] in _BEFORE_CALLS):
        return False
    return bool(before) or not bodiless


def without_heads(clean: str) -> str:
    """Code of the same length in which declared names are crossed out (and the members that a constructor's list initialises), so that
    what stands before brackets is called."""
    out = list(clean)
    blank = lambda a, b: out.__setitem__(slice(a, b), "#" * (b - a))
    for pattern, bodiless in ((_METHOD, False), (_BODILESS, True)):
        at = 0
        while m := pattern.search(clean, at):
            at = m.end(2)
            if not _is_declaration(m[1], m[2], bodiless):
                continue
            # `Class::method` outside its class: the qualified name is the declared one.
            low = m.start(2)
            while low and (clean[low - 1].isalnum() or clean[low - 1] in "_:"):
                low -= 1
            begin = low + re.search(r"(?:\w+::)*$", clean[low : m.start(2)]).start()
            blank(begin, m.end(2))
            if not bodiless and ":" in m[4]:
                depth, first = 0, m.start(4)
                for i in range(m.start(4), m.end(4)):
                    if clean[i] in "({":
                        if not depth and (n := _INITIALIZED.search(clean[first:i])):
                            blank(first + n.start(1), first + n.end(1))
                        depth += 1
                    elif clean[i] in ")}":
                        depth, first = depth - 1, i + 1
    return "".join(out)


def _spans(clean: str, pattern: re.Pattern) -> list[tuple[re.Match, int, int]]:
    """Matches that end in a brace, with the block's begin and end."""
    return [(m, m.end() - 1, block_end(clean, m.end() - 1)) for m in pattern.finditer(clean)]


def _begin(clean: str, m: re.Match) -> int:
    """Where a declaration's own text begins: after the separator and the blanks that the match starts with."""
    return m.start() + len(re.match(r"[;{}\]\n:>]?\s*", m[0])[0])


def _methods(clean: str, low: int, high: int) -> list[tuple[re.Match, int, int]]:
    """Outermost functions with a body between low and high."""
    out, at = [], low
    while m := _METHOD.search(clean, at, high):
        if not _is_declaration(m[1], m[2], False) or re.search(r"\b(?:class|struct|namespace)\b", m[0]):
            at = m.end(2)
            continue
        end = block_end(clean, m.end() - 1)
        out.append((m, m.end() - 1, end))
        at = end - 1 if end > m.end() else m.end()
    return out


def parse_csharp(path: str, text: str, root: str = "") -> list[Chunk]:
    """Classes, and the methods, constructors and properties of all types; interfaces, structs and records only give them names."""
    short = Squeezed(blanked(text))
    clean, at, after = short.code, short.at, short.after
    code = without_heads(clean)
    namespaces = [(m[1], m.start(), block_end(clean, m.end() - 1) if m[2] == "{" else len(clean)) for m in _NAMESPACE.finditer(clean)]
    types = _spans(clean, _CS_TYPE)
    where, module, chunks = normal(path), parent(path), []

    def full(place: int, name: str) -> str:
        outer = [n for n, a, b in namespaces if a < place < b] + [m[2] for m, a, b in types if a < place < b]
        return ".".join([*outer, name])

    for m, brace, end in types:
        start = m.start()
        methods = _methods(clean, brace, end)
        bodies = [(a, b) for _, a, b in methods]
        if m[1] == "class":
            chunks.append(Chunk(full(start, m[2]), m[2], "class", hollow(text[at(start) : after(end)], [(at(a), after(b)) for a, b in bodies], at(start), C_SKIPPED), where, line_of(text, at(start)), "c_sharp", module, csharp_calls(code[start:end])))
        inner = [(a, b) for _, a, b in types if brace < a and b <= end]
        for f, a, b in methods:
            if any(x < f.end() < y for x, y in inner):
                continue
            s = _begin(clean, f)
            chunks.append(Chunk(full(f.end() - 1, f[2]), f[2], "function", text[at(s) : after(b)], where, line_of(text, at(s)), "c_sharp", module, csharp_calls(code[s:b])))
        for p in _PROPERTY.finditer(clean, brace, end):
            if any(a < p.end() < b for a, b in bodies) or any(x < p.end() < y for x, y in inner):
                continue
            s = _begin(clean, p)
            brace_at = clean.find("{", p.start(1), p.end())
            stop = block_end(clean, brace_at) if brace_at >= 0 else clean.find(";", p.end()) + 1 or end
            chunks.append(Chunk(full(p.end(), p[1]), p[1], "property", text[at(s) : after(stop)], where, line_of(text, at(s)), "c_sharp", module, csharp_calls(code[s:stop])))
    return [*chunks, file_chunk(path, text, "c_sharp", csharp_file_name(path, text), module, chunks)]


def csharp_file_name(path: str, text: str) -> str:
    """Qualified name of a file: with the first namespace of its text, if any."""
    found = re.search(NAMESPACE_PATTERN, text)
    return f"{found[1]}.{base(path)}" if found else base(path)


def parse_cpp(path: str, text: str, root: str = "") -> list[Chunk]:
    """Class skeletons; methods of managed (ref) classes inside them; in .cpp files methods defined outside their class."""
    short = Squeezed(blanked(text))
    clean, at, after = short.code, short.at, short.after
    code = without_heads(clean)
    found = _NAMESPACE.search(clean)
    where, module, chunks = normal(path), parent(path), []
    prefix = found[1].replace("::", ".") + "." if found else ""
    for m, brace, end in _spans(clean, _CPP_TYPE):
        start = m.start()
        methods = _methods(clean, brace, end)
        managed = bool(m[1])
        outer = prefix or (stem(path) + "." if managed else "")
        if managed:
            for f, a, b in methods:
                s = _begin(clean, f)
                chunks.append(Chunk(f"{outer}{m[2]}.{f[2]}", f[2], "method", text[at(s) : after(b)], where, line_of(text, at(s)), "cpp", module, cpp_calls(code[s:b])))
        skeleton = hollow(text[at(start) : after(end)], [(at(a), after(b)) for _, a, b in methods], at(start), C_SKIPPED)
        chunks.append(Chunk(f"{outer}{m[2]}", m[2], "class", skeleton, where, line_of(text, at(start)), "cpp", module, cpp_calls(code[start:end])))
    if path.lower().endswith(".cpp"):
        known = {c.qualified_name for c in chunks}
        for m, brace, end in _spans(clean, _OUTSIDE):
            name = f"{prefix}{m[1]}.{m[2]}"
            if name not in known:
                s = _begin(clean, m)
                chunks.append(Chunk(name, m[2], "method", text[at(s) : after(end)], where, line_of(text, at(s)), "cpp", module, cpp_calls(code[s:end])))
                known.add(name)
    included = list(dict.fromkeys(_INCLUDE.findall(text)))
    return [*chunks, file_chunk(path, text, "cpp", base(path), module, chunks, includes=included)]
