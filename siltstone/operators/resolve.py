"""From called names to edges. Priorities are chained equality joins and coalesce, so no join needs an OR.

chunks: qualified_name, name, type, language, module_path, content, ord (order in which chunks were stored).
calls: caller_qn, language, module_path, called_name, plus any key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import binding_roots


def name_index(chunks: DataFrame) -> DataFrame:
    """name, n, first_qn: functions and methods by name, in stored order."""
    return _index(chunks.where(F.col("type").isin("function", "method")))


def _index(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by("qualified_name", F.struct("ord", "qualified_name")).alias("first_qn"))


def _known(chunks: DataFrame, alias: str) -> DataFrame:
    return chunks.select(F.col("qualified_name").alias(alias)).distinct()


def resolve_python(calls: DataFrame, imports: DataFrame, chunks: DataFrame) -> DataFrame:
    """calls with target_qn (null if unresolved) and stage: 0 unresolved, 1 same module, 2 import alias, 3 the only function of that name.
    imports: owner_qn, alias, target_qn."""
    wanted = F.concat(F.regexp_replace("module_path", r"[/\\]", "."), F.lit("."), F.col("called_name"))
    rows = calls.where(F.col("language") == "python").withColumn("__want", wanted)
    rows = rows.join(_known(chunks, "__one"), F.col("__want") == F.col("__one"), "left")
    alias = imports.join(_known(chunks, "target_qn"), "target_qn", "left_semi").groupBy("owner_qn", "alias").agg(F.min("target_qn").alias("__two"))
    rows = rows.join(alias, (F.col("caller_qn") == F.col("owner_qn")) & (F.col("called_name") == F.col("alias")), "left").drop("owner_qn", "alias")
    only = name_index(chunks).where("n = 1").select(F.col("name").alias("__name"), F.col("first_qn").alias("__three"))
    rows = rows.join(only, F.col("called_name") == F.col("__name"), "left")
    stage = F.when(F.col("__one").isNotNull(), 1).when(F.col("__two").isNotNull(), 2).when(F.col("__three").isNotNull(), 3).otherwise(0)
    return rows.select(*calls.columns, F.coalesce("__one", "__two", "__three").alias("target_qn"), stage.alias("stage"))


def _namespace(qn):
    return F.when(qn.contains("."), F.regexp_replace(qn, r"\.[^.]*$", "")).otherwise(F.lit(""))


def resolve_csharp(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """calls with target_qn and stage: 1 same class, 2 the only candidate, 3 first candidate of the namespace, 4 first one."""
    rows = calls.where(F.col("language") == "c_sharp").withColumn("__ns", _namespace(F.col("caller_qn")))
    rows = rows.withColumn("__want", F.when(F.col("__ns") != "", F.concat("__ns", F.lit("."), "called_name")))
    rows = rows.join(_known(chunks, "__one"), F.col("__want") == F.col("__one"), "left")
    index = name_index(chunks).select(F.col("name").alias("__name"), F.col("n").alias("__n"), F.col("first_qn").alias("__first"))
    rows = rows.join(index, F.col("called_name") == F.col("__name"), "left")
    functions = chunks.where(F.col("type").isin("function", "method")).withColumn("__cns", _namespace(F.col("qualified_name")))
    near = functions.groupBy(F.col("name").alias("__cname"), "__cns").agg(F.min_by("qualified_name", F.struct("ord", "qualified_name")).alias("__near"))
    rows = rows.join(near, (F.col("called_name") == F.col("__cname")) & (F.col("__ns") == F.col("__cns")), "left")
    target = F.when(F.col("__one").isNotNull(), F.col("__one")).when(F.col("__n") == 1, F.col("__first")).otherwise(F.coalesce("__near", "__first"))
    stage = F.when(F.col("__one").isNotNull(), 1).when(F.col("__n") == 1, 2).when(F.col("__near").isNotNull(), 3).when(F.col("__first").isNotNull(), 4).otherwise(0)
    return rows.select(*calls.columns, target.alias("target_qn"), stage.alias("stage"))


#: Fixed value: what follows a view's name in that of its model.
MODEL = "Model"


def _views_meant(qn):
    """All texts that stand right before MODEL somewhere in a qualified name: the names of views whose models it may belong to."""
    found = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(qn) - len(MODEL) + 1)), lambda i: F.substr(qn, i, F.lit(len(MODEL))) == MODEL)
    return F.array_distinct(F.flatten(F.transform(found, lambda i: F.transform(F.sequence(F.lit(1), i - 1), lambda j: F.substr(qn, j, i - j)))))


def resolve_bindings(chunks: DataFrame) -> DataFrame:
    """caller_qn, property, pos, target_qn: each {Binding} of a view with the property it means: one whose qualified name holds
    `<view>Model`, else the first of that name. The views that a property may belong to are read off its own name, so the
    join is one of equal keys and a property name that many classes have multiplies nothing."""
    views = chunks.where(F.col("language").isin("xaml", "html")).select(F.col("qualified_name").alias("caller_qn"), F.replace("name", F.lit(".xaml"), F.lit("")).alias("view"), F.posexplode(binding_roots(F.col("content"))).alias("pos", "property"))
    props = chunks.where(F.col("type") == "property").select(F.col("name").alias("property"), F.col("qualified_name").alias("target"), "ord")
    first = props.groupBy("property").agg(F.min_by("target", F.struct("ord", "target")).alias("first"))
    own = props.where(F.col("target").contains(MODEL)).select("property", "target", "ord", F.explode(_views_meant(F.col("target"))).alias("view"))
    named = own.groupBy("view", "property").agg(F.min_by("target", F.struct("ord", "target")).alias("named"))
    return views.join(first, "property").join(named, ["view", "property"], "left").select("caller_qn", "property", "pos", F.coalesce("named", "first").alias("target_qn"))


def affected_callers(calls: DataFrame, imports: DataFrame, views: DataFrame, changed: DataFrame) -> DataFrame:
    """caller_qn: chunks whose edges may differ once the chunks `changed` (qualified_name, name: as they were, and as they
    are) have been put in: those themselves, and those that call, import or bind one of their names."""
    names = changed.select(F.col("name").alias("__n")).distinct()
    qns = changed.select(F.col("qualified_name").alias("__q")).distinct()
    near = F.when(F.col("language") == "python", F.regexp_replace("module_path", r"[/\\]", ".")).otherwise(_namespace(F.col("caller_qn")))
    wanted = calls.select("caller_qn", "called_name", F.concat(near, F.lit("."), "called_name").alias("wanted"))
    parts = [
        changed.select(F.col("qualified_name").alias("caller_qn")),
        wanted.join(names, F.col("called_name") == F.col("__n"), "left_semi").select("caller_qn"),
        wanted.join(qns, F.col("wanted") == F.col("__q"), "left_semi").select("caller_qn"),
        imports.join(qns, F.col("target_qn") == F.col("__q"), "left_semi").select(F.col("owner_qn").alias("caller_qn")),
        views.select("caller_qn", F.explode(binding_roots(F.col("content"))).alias("root")).join(names, F.col("root") == F.col("__n"), "left_semi").select("caller_qn"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def build_edges(calls: DataFrame, imports: DataFrame, chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct caller_qn, callee_qn of all languages; C and C++ calls make no edges. Names are looked up in `known` (else in
    chunks); the views among chunks are resolved."""
    known = chunks if known is None else known
    parts = [resolve_python(calls, imports, known).select("caller_qn", "target_qn"), resolve_csharp(calls, known).select("caller_qn", "target_qn"), resolve_bindings(chunks).select("caller_qn", "target_qn")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where("target_qn IS NOT NULL").select("caller_qn", F.col("target_qn").alias("callee_qn")).distinct()
