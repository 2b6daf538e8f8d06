"""Queries that run the engine's own choices: which search answers a question, and which prompt it gets."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.contract import VECTOR, _hybrid_sql
from siltstone.plans.prompts import TEMPLATES
from siltstone.plans.registry import query
from siltstone.session import Route

_TRACE = 'Traceback (most recent call last):\n  File "m7.py", line 3, in f\nValueError: x'
#: Name, question, route: one for every strategy.
ROUTES = {
    "target": ("of the d12", Route(target="d12")),
    "files": ("both", Route(filenames=["m7.py", "m12.py"])),
    "file": ("one", Route(filenames=["m3.py"])),
    "trace": (_TRACE, Route(has_traceback=True)),
    "blind": ("error at die von", Route(has_traceback=True)),
    "language": ("x", Route(language="csharp")),
    "keywords": ("ignored", Route(keywords=["avec", "les"])),
    "short": ("con una las", Route(keywords=["a"])),
}
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(f"CAST({x} AS DOUBLE)" for x in VECTOR) + "])"


def _path(keyword: str, k: int) -> str:
    return f"SELECT qualified_name FROM (SELECT qualified_name FROM vectors WHERE filepath ILIKE '%{keyword}%' ORDER BY filepath, start_line, qualified_name LIMIT {k})"


def _found(question: str, names: list[str], top_k: int) -> str:
    return _hybrid_sql(question, names, [], top_k, "SELECT qualified_name FROM ranked")


_BY_ROUTE = {
    "target": _found("of the d12", ["d12"], 10),
    "files": f"{_path('m7.py', 20)} UNION ALL {_path('m12.py', 20)}",
    "file": _path("m3.py", 50),
    "trace": _path("m7.py", 50),
    "blind": _found("error at die von", ["error", "die", "von"], 5),
    "language": f"SELECT qualified_name FROM (SELECT qualified_name FROM vectors WHERE language = 'c_sharp' ORDER BY {_COS} DESC, qualified_name LIMIT 10)",
    "keywords": _found("avec les", ["avec", "les"], 5),
    "short": _found("con una las", ["con", "una", "las"], 5),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS route, qualified_name FROM ({sql})" for name, sql in _BY_ROUTE.items()), "vectors")
def retrieve_routes(t):
    """What each strategy finds."""
    engine, out = t.engine(embedder=lambda _: [VECTOR]), None
    for name, (question, route) in ROUTES.items():
        rows = engine.retrieve(question, route).select(F.lit(name).alias("route"), "qualified_name")
        out = rows if out is None else out.unionByName(rows)
    return out


_CONTEXT = """(SELECT '<context>' || chr(10) || string_agg(chr(10) || '    <file index="' || i || '" path="' || filepath || '" start_line="' || start_line || '" language="' || language || '" type="' || type || '">' || chr(10) || '<![CDATA[' || chr(10) || content || chr(10) || ']]>' || chr(10) || '    </file>' || chr(10), '' ORDER BY i) || '</context>' AS c
FROM (SELECT *, row_number() OVER (ORDER BY filepath, start_line, qualified_name) AS i FROM vectors WHERE filepath ILIKE '%m3.py%' ORDER BY filepath, start_line, qualified_name LIMIT 7))"""


def _prompt_sql(kind: str) -> str:
    filled = TEMPLATES.get(kind, TEMPLATES["general"]).format(query=_TRACE, context="{context}", target="m3.py", traceback=_TRACE, language="python")
    return "replace('" + filled.replace("'", "''") + "', '{context}', c)"


KINDS = (*TEMPLATES, "search")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, {_prompt_sql(k)} AS prompt FROM {_CONTEXT}" for k in KINDS), "vectors")
def build_prompts(t):
    """The prompt of every kind of question over the same hits; kinds without a template get the general one."""
    engine = t.engine(embedder=lambda _: [VECTOR])
    hits = engine.retrieve("", Route(filenames=["m3.py"])).limit(7)
    rows = [(k, engine.build_prompt(_TRACE, hits, Route(k, filenames=["m3.py"]))) for k in KINDS]
    return t.spark.createDataFrame(rows, "kind string, prompt string")
