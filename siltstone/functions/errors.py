"""Error logs: tracebacks of Python and C# as arrays of frames, severity, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels by error type.
PYTHON_LEVELS = {
    "AttributeError": "Level2", "TypeError": "Level2", "ValueError": "Level2", "KeyError": "Level2", "IndexError": "Level2",
    "NameError": "Level1", "ImportError": "Level1", "SyntaxError": "Level1", "IndentationError": "Level1", "ZeroDivisionError": "Level3",
    "FileNotFoundError": "Level2", "PermissionError": "Level2", "RuntimeError": "Level3",
}
CSHARP_LEVELS = {
    "NullReferenceException": "Level1", "ArgumentNullException": "Level2", "InvalidOperationException": "Level2", "ArgumentException": "Level2",
    "IndexOutOfRangeException": "Level2", "KeyNotFoundException": "Level2", "DivideByZeroException": "Level3", "FileNotFoundException": "Level2",
    "UnauthorizedAccessException": "Level2", "NotImplementedException": "Level2",
}
DEFAULT_LEVEL = "Level2"
#: Patterns of error lines and frames.
_PY_ERROR = r"([A-Z][a-zA-Z]+Error|[A-Z][a-zA-Z]+Exception):\s*(.+?)(?:\n|$)"
_CS_ERROR = r"(System\.[A-Z][a-zA-Z]+Exception|[A-Z][a-zA-Z]+Exception):\s*(.+?)(?:\n|$)"
_PY_FRAME = r'File "([^"]+)",\s*line\s*(\d+),\s*in\s*(\S+)'
_CS_STRICT = r"at\s+([^\s]+)\s+in\s+([^:]+):line\s+(\d+)"
_CS_FIXED = r"at\s+([^\s(]+(?:\([^)]*\))?)\s+in\s+((?:[A-Za-z]:)?[^:]+):line\s+(\d+)"


def severity(error_type: Column) -> Column:
    levels = CSHARP_LEVELS | PYTHON_LEVELS
    table = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return F.coalesce(F.element_at(table, error_type), F.lit(DEFAULT_LEVEL))


def trace_language(text: Column) -> Column:
    csharp = text.contains("at System.") | text.contains("at Microsoft.") | text.contains("System.Exception:") | text.contains("   at ")
    return F.when(text.contains("Traceback (most recent call last):"), "python").when(csharp | text.contains(".cs:line") | text.contains(".cs'"), "csharp").otherwise("python")


def _part(text: Column, pattern: str, group: int, default: str) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(text.rlike(pattern), F.trim(found)).otherwise(F.lit(default))


def python_frames(text: Column) -> Column:
    """Frames in order of appearance; the snippet is the stripped line after the first line with the frame's text."""
    kind, message = _part(text, _PY_ERROR, 1, "UnknownError"), _part(text, _PY_ERROR, 2, "Unknown error")
    lines = F.split(text, "\n")

    def frame(m: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda line: line.contains(m)), F.lit(True))
        after = F.when(at > 0, F.get(lines, at.cast("int")))
        return F.struct(
            F.regexp_extract(m, _PY_FRAME, 1).alias("filepath"),
            F.regexp_extract(m, _PY_FRAME, 2).cast("int").alias("line_number"),
            F.regexp_extract(m, _PY_FRAME, 3).alias("function_name"),
            F.coalesce(F.trim(F.regexp_replace(after, r"^\s+|\s+$", "")), F.lit("")).alias("code_snippet"),
            kind.alias("error_type"),
            message.alias("error_message"),
            F.lit("python").alias("language"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(_PY_FRAME), 0), frame)


def csharp_frames(text: Column, strict: bool = True) -> Column:
    """Frames in order of appearance. strict: paths without a colon and methods without blanks; else also drive letters
    and argument lists. Doubled (not strict: all) backslashes become slashes."""
    pattern = _CS_STRICT if strict else _CS_FIXED
    kind = F.element_at(F.split(_part(text, _CS_ERROR, 1, "UnknownException"), r"\."), -1)
    message = _part(text, _CS_ERROR, 2, "Unknown C# error")

    def frame(m: Column) -> Column:
        path = F.trim(F.regexp_extract(m, pattern, 2))
        method = F.regexp_extract(m, pattern, 1)
        method = method if strict else F.regexp_replace(method, r"\(.*$", "")
        return F.struct(
            (F.replace(path, F.lit("\\\\"), F.lit("/")) if strict else F.replace(path, F.lit("\\"), F.lit("/"))).alias("filepath"),
            F.regexp_extract(m, pattern, 3).cast("int").alias("line_number"),
            F.replace(F.element_at(F.split(method, r"\."), -1), F.lit("()"), F.lit("")).alias("function_name"),
            F.lit("").alias("code_snippet"),
            kind.alias("error_type"),
            message.alias("error_message"),
            F.lit("csharp").alias("language"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), frame)


def frames(text: Column, strict: bool = True) -> Column:
    return F.when(trace_language(text) == "csharp", csharp_frames(text, strict)).otherwise(python_frames(text))


def chain_text(found: Column) -> Column:
    """One indented line a frame."""
    return F.array_join(F.transform(found, lambda f, i: F.concat(F.repeat(F.lit("  "), i), F.lit("→ "), f["function_name"], F.lit(" ("), f["filepath"], F.lit(":"), f["line_number"].cast("string"), F.lit(")"))), "\n")


def diagnosed(errors: DataFrame, text_col: str = "error_text", strict: bool = True) -> DataFrame:
    """errors with frames, location (last frame), root_cause (first frame if there are several), severity, chain, success
    and search_text (what related code is searched by). No model is asked."""
    out = errors.withColumn("frames", frames(F.col(text_col), strict))
    n = F.size("frames")
    out = out.withColumn("location", F.try_element_at("frames", F.lit(-1))).withColumn("root_cause", F.when(n > 1, F.get("frames", F.lit(0))))
    return out.select(
        "*",
        (n > 0).alias("success"),
        n.alias("depth"),
        F.when(n > 0, severity(F.col("location.error_type"))).alias("severity"),
        chain_text(F.col("frames")).alias("chain"),
        F.array_distinct(F.transform("frames", lambda f: f["filepath"])).alias("related_files"),
        F.concat_ws(" ", "location.filepath", "location.function_name").alias("search_text"),
        F.concat_ws(" ", "location.error_type", "location.function_name").alias("similar_text"),
    )


#: Texts in one batch.
BATCH = 10


def batch(errors: DataFrame, id_col: str, text_col: str = "error_text") -> DataFrame:
    """One row a text: its id, success, error_type, severity, depth, what was wrong (null if nothing), and a summary of 200
    characters. A text that cannot be read fails alone."""
    out = diagnosed(errors.select(id_col, F.col(text_col).alias("error_text")))
    summary = F.left(F.when(F.col("success"), F.col("chain")).otherwise(F.coalesce("error_text", F.lit(""))), F.lit(200))
    return out.select(id_col, F.coalesce("success", F.lit(False)).alias("success"), "location.error_type", "severity", F.col("depth").cast("long").alias("depth"), F.when(~F.coalesce("success", F.lit(False)), "no frames").alias("failure"), summary.alias("summary"))
