"""Text expressions: tokens, names, paths, escaping, routing rules. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TOKEN_SEPARATORS = "_.()[]{}=:,;\"'/"
#: What str.split() takes for white space, apart from the blank.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20)
NAME_STOP_WORDS = (
    "what", "does", "how", "why", "where", "when",
    "function", "class", "method", "file", "code", "this",
    "that", "the", "is", "are", "do", "can", "will", "from",
    "property", "event", "handler", "view", "model", "ViewModel",
    "get", "set", "public", "private", "void", "string", "int",
)
IGNORED_DIRS = (".git", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", ".idea", ".vscode", "site-packages", "egg-info")
IGNORED_FILES = (".DS_Store", "poetry.lock", "package-lock.json", ".gitignore")
RESERVED_WORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await",
    "break", "class", "continue", "def", "del", "elif", "else", "except",
    "finally", "for", "from", "global", "if", "import", "in", "is",
    "lambda", "nonlocal", "not", "or", "pass", "raise", "return",
    "try", "while", "with", "yield",
)
EVENT_ATTRIBUTES = ("Click", "Loaded", "Unloaded", "SelectionChanged", "TextChanged", "MouseDoubleClick")
NAME_PATTERN = r"\b([A-Z][a-zA-Z0-9_]*|[a-z_][a-z0-9_]{2,})\b"
FILE_PATTERNS = (r"\b[\w-]+\.py\b", r"\b[\w-]+\.cs\b", r"\b[\w-]+\.xaml\b")
CALL_NAME_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_.]*$"
NAMESPACE_PATTERN = r"namespace\s+([A-Za-z0-9_.]+)"
INCLUDE_PATTERN = '#include\\s*[<"]([^>"]+)[>"]'
BINDING_PATTERN = r"\{Binding\s+(?:Path=)?([a-zA-Z0-9_.]+)"
TRACEBACK_PATTERN = r"(?s)(Traceback.*?)(?:\n\n|\z)"
TRACE_FILE_PATTERNS = ('File "([^"]+)"', r"in ([^:]+\.cs):line")
VM_CONTEXT = "__vm_context__:"
SHORT_CODE = "단순 속성/선언부: `"


def tokens(text: Column, split_camel: bool = False) -> Column:
    """Lower-cased search tokens: separators and all white space become blanks, at which the text is cut (one blank as pattern takes
    Java's fast split). split_camel parts camelCase first."""
    gone = TOKEN_SEPARATORS + WHITE_SPACE
    clean = F.translate(F.coalesce(text, F.lit("")), gone, " " * len(gone))
    if split_camel:
        clean = F.regexp_replace(clean, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(clean), " "), lambda t: t != "")


def query_tokens(query: str) -> list[str]:
    """tokens() of a query on the driver; repeats are kept, they count."""
    return query.translate(str.maketrans(dict.fromkeys(TOKEN_SEPARATORS, " "))).lower().split()


def identifiers(query: Column) -> Column:
    """Distinct names in a question: capitalised words, or lower-case ones of three characters; stop words are compared
    in lower case, so the one with capitals never excludes anything."""
    found = F.regexp_extract_all(query, F.lit("(?U)" + NAME_PATTERN), 1)
    keep = lambda w: ~F.lower(w).isin(*NAME_STOP_WORDS) & ((F.length(w) >= 3) | w.contains("_") | w.rlike("^[A-Z]"))
    return F.array_distinct(F.filter(found, keep))


def file_names(query: Column) -> Column:
    """Names ending in .py, then .cs, then .xaml; repeats stay."""
    return F.concat(*[F.regexp_extract_all(query, F.lit("(?U)" + p), 0) for p in FILE_PATTERNS])


def valid_name(name: Column) -> Column:
    """A call's name that may be a function: 2 to 50 characters, an identifier with dots, no reserved word."""
    n = F.trim(name)
    good = F.length(n).between(2, 50) & n.rlike(CALL_NAME_PATTERN) & ~n.rlike(r"^[_.]+$") & ~n.isin(*RESERVED_WORDS)
    return F.coalesce(good, F.lit(False))


def storable_calls(calls: Column) -> Column:
    """Calls kept at an upsert: context links, or short ones without a blank or #."""
    return F.filter(calls, lambda c: c.startswith(VM_CONTEXT) | ((F.length(c) <= 200) & ~c.contains(" ") & ~c.contains("#")))


def embed_text(name: Column, kind: Column, summary: Column, path: Column) -> Column:
    """The text that is embedded: metadata and summary, not code."""
    return F.concat(F.lit("Name: "), name, F.lit("\nType: "), kind, F.lit("\nSummary: "), F.coalesce(summary, F.lit("")), F.lit("\nPath: "), path)


def skipped_path(path: Column, root: str) -> Column:
    """True for ignored or hidden files and directories, anywhere below root; outside root only the name counts."""
    name = F.element_at(F.split(path, "/"), -1)
    hidden = lambda part: part.startswith(".") & (part != ".")
    base = root.rstrip("/") + "/"
    parts = F.split(F.substr(path, F.lit(len(base) + 1)), "/")
    inside = path.startswith(base) & F.exists(parts, lambda p: p.isin(*IGNORED_DIRS) | hidden(p))
    return name.isin(*IGNORED_DIRS, *IGNORED_FILES) | hidden(name) | inside


def source_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included, clipped) without trailing white space; a null text is an error text."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), start)
    last = F.least(end, F.size(lines))
    cut = F.when(last >= first, F.slice(lines, first, F.greatest(F.lit(0), last - first + 1))).otherwise(F.array().cast("array<string>"))
    return F.when(text.isNull(), F.lit("# Error: File not found")).otherwise(F.regexp_replace(F.array_join(cut, "\n"), r"\s+$", ""))


def normal_path(path: Column) -> Column:
    """A path without parts that repeat the part before."""
    return F.array_join(F.transform(F.filter(F.transform(F.split(path, "/"), lambda p, i: F.struct(p.alias("p"), F.get(F.split(path, "/"), i - 1).alias("q"))), lambda x: x["q"].isNull() | (x["p"] != x["q"])), lambda x: x["p"]), "/")


def module_path(path: Column, language: Column) -> Column:
    """Python: the dotted path without suffix; others: the parent directory ('.' if there is none)."""
    dotted = F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    parent = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))
    return F.when(language == "python", dotted).otherwise(parent)


def file_qualified_name(path: Column, content: Column) -> Column:
    """Python: dotted module and .py; C#: first namespace and file name; else the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    namespace = F.regexp_extract(content, NAMESPACE_PATTERN, 1)
    return (
        F.when(name.endswith(".py"), F.concat(module_path(path, F.lit("python")), F.lit(".py")))
        .when(name.endswith(".cs") & (namespace != ""), F.concat_ws(".", namespace, name))
        .otherwise(name)
    )


def includes(content: Column) -> Column:
    """Distinct files named by #include, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(INCLUDE_PATTERN), 1))


def binding_roots(content: Column) -> Column:
    """First names of all {Binding ...} expressions, repeats kept."""
    found = F.regexp_extract_all(content, F.lit(BINDING_PATTERN), 1)
    return F.transform(found, lambda b: F.split_part(b, F.lit("."), F.lit(1)))


def attribute_values(html: Column, attribute: str) -> Column:
    """Sorted distinct values of an attribute of a markup text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(attribute + '="([^"]*)"'), 1)))


def summary_input(code: Column, limit: int = 3000) -> Column:
    """What a summariser gets: the code, cut at limit characters."""
    return F.when(F.length(code) > limit, F.concat(F.substring(code, 1, limit), F.lit("\n... (truncated)"))).otherwise(code)


def short_summary(code: Column) -> Column:
    """The literal summary of code under 80 characters, else null (a model's task)."""
    stripped = F.regexp_replace(code, r"^\s+|\s+$", "")
    return F.when(F.length(stripped) < 80, F.concat(F.lit(SHORT_CODE), F.regexp_replace(stripped, r"\s+", " "), F.lit("`")))


def without_thoughts(answer: Column) -> Column:
    """A model's answer without <think> blocks, also one that is not closed."""
    return F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def escape_mdx(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("{", "&#123;"), ("}", "&#125;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def doc_folder(path: Column, root: str) -> Column:
    """Folder of a page: of a relative path its parent; of others the parent, from the parent of root on, or else the
    parent's name alone."""
    base = root.rstrip("/").rpartition("/")[0] + "/"
    parent = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    within = F.when(path.startswith(base), F.substr(parent, F.lit(len(base) + 1))) if root else F.lit(None).cast("string")
    return F.when(~path.startswith("/"), parent).otherwise(F.coalesce(within, F.element_at(F.split(parent, "/"), -1)))


def icon(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.contains("class"), "📦").when(k.contains("property"), "🔧").when(k.contains("method"), "⚡").otherwise("🔹")


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def routed_language(query: Column) -> Column:
    """Rule used when no model classifies the question."""
    return F.when(query.contains(".cs") | query.contains(".xaml") | query.contains("ViewModel") | query.contains("Binding"), "csharp").otherwise("python")


def has_traceback(query: Column) -> Column:
    return F.lower(query).rlike("traceback|exception|error at")


def traceback_block(query: Column) -> Column:
    """From `Traceback` to the next empty line or the end; else the whole question."""
    found = F.regexp_extract(query, TRACEBACK_PATTERN, 1)
    return F.when(found != "", found).otherwise(query)


def traceback_files(query: Column) -> Column:
    """Distinct files named by Python and C# frames, sorted."""
    both = F.concat(*[F.regexp_extract_all(query, F.lit(p), 1) for p in TRACE_FILE_PATTERNS])
    return F.array_sort(F.array_distinct(both))


def search_text(keywords: Column, query: Column) -> Column:
    """Keywords joined by blanks; the question itself if that is under five characters."""
    joined = F.array_join(keywords, " ")
    return F.when(F.length(joined) < 5, query).otherwise(joined)


#: What stands for a model's thinking tags.
THINKING, THOUGHT = "\n> 🧠 **[코드 분석 중...]**\n> ", "\n\n**[분석 완료]**\n\n"


def thinking_tags(answer: Column) -> Column:
    """A model's answer with its thinking tags shown as text."""
    return F.replace(F.replace(answer, F.lit("<thinking>"), F.lit(THINKING)), F.lit("</thinking>"), F.lit(THOUGHT))


def python_module(path: str, root: str) -> str:
    """Dotted module of a file below root (without one: of a relative path), else its stem."""
    base = root.rstrip("/") + "/" if root else ""
    rel = path[len(base) :] if path.startswith(base) and not (path.startswith("/") and not base) else path.rpartition("/")[2]
    return re.sub(r"\.[^./]*$", "", rel).replace("/", ".")
