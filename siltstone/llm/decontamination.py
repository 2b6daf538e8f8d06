"""Benchmark decontamination by winnowing, in DataFrame expressions only.

An item's windows are its runs of WINDOW words (a shorter item is one window of all its words). A window of m
words holds m - k + 1 grams of k = min(GRAM, m) words; winnowing keeps the least gram hash of each such run of
grams. So every window of the benchmark that occurs in a document shares a kept hash with it, wherever it
stands: no shared span of m words is missed.

1. Fingerprints: documents' kept hashes are joined with the benchmark's. Only ids and hashes travel.
2. Extension: in documents with a common hash, the windows around it are cut out and joined with the benchmark's
   distinct windows by their words, so hash collisions do no harm. Distinct windows, not items, are joined, so
   a passage that many items or documents share costs each of them once.

3. Items: each distinct window bears the key of its set of items, and each set is held once. A document gathers the
   distinct keys of its windows; only then the sets are joined to it and united. So neither the windows of a
   document nor the documents of a window are multiplied by items.

The benchmark's side of a join is broadcast only if it has been counted to be small; likewise the documents with
common hashes. Else Spark joins by shuffle (unique keys on that side, so skewed keys can be split).

Defined cases: null and empty texts have no words and no hits; items without words are ignored; repeated rows
give repeated rows, and rows with equal ids but other texts are judged each by its own text; items with equal
ids count once; an empty benchmark leaves everything clean; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import let, only_columns, small, stored

WINDOW, GRAM = 10, 6
#: Long windows and long lists of items count as several rows when a side's size is checked.
ROW_BYTES = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z alone."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def _starts(n: Column, width: int) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each position on."""
    return let(words, lambda w: F.transform(_starts(F.size(w), k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))


def winnowed(words: Column, m: int) -> Column:
    """Distinct least hashes of the grams in each run of m words."""
    k = min(GRAM, m)
    run = m - k + 1
    hashes = gram_hashes(words, k)
    if run == 1:
        return F.array_distinct(hashes)
    least = lambda h: F.transform(_starts(F.size(h), run), lambda i: F.least(*[F.get(h, i + j) for j in range(run)]))
    return F.array_distinct(let(hashes, least))


def _window_table(items: DataFrame) -> DataFrame:
    """One row a distinct window: m, gram (its words joined by blanks), item_set (key of the set of its items), items."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("m"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))
    w = w.select("item", "m", F.explode(grams).alias("gram")).groupBy("m", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return w.select("m", "gram", F.md5(F.to_json("items")).alias("item_set"), "items")


def hit_words(spans: Column) -> Column:
    """Number of positions in the union of spans (s, m), sorted by s."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["s"] + x["m"] - F.greatest(a["end"], x["s"]))).cast("long").alias("n"), F.greatest(a["end"], x["s"] + x["m"]).alias("end")),
        lambda a: a["n"],
    )


def _tagged(hashes: Column, m: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(m).alias("m"), h.alias("h")))


def _hashes_of(prints: Column, m: int) -> Column:
    return F.transform(F.filter(prints, lambda p: p["m"] == m), lambda p: p["h"])


def matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_hash, n_words, n_hit, items (array of item ids, sorted as strings)."""
    docs = only_columns(documents, id_col, text_col).toDF("doc_id", "text")
    items = only_columns(benchmark, item_col, item_text_col).toDF("item_id", "text")
    table = stored(_window_table(items), "bench-windows")
    distinct = table.select("m", "gram", "item_set")
    weight = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("gram")), F.sum(F.octet_length(F.to_json("items")))).first()
    n_windows, n_sets = (max(weight[0], (weight[0] and bytes_) // ROW_BYTES) for bytes_ in weight[1:])
    lengths = sorted(r["m"] for r in distinct.select("m").distinct().collect())  # WINDOW values at most
    # Every kept hash of a window of m words, taken from the window itself.
    keys = None
    for m in lengths:
        own = distinct.where(F.col("m") == m).select(F.col("m").alias("km"), F.explode(winnowed(F.split("gram", " "), m)).alias("kh"))
        keys = own if keys is None else keys.unionByName(own)
    if keys is None:
        keys = distinct.select(F.col("m").alias("km"), F.lit(0).cast("long").alias("kh")).limit(0)
    keys = keys.distinct()
    # 1. Documents' fingerprints against the benchmark's.
    tokens = docs.select("doc_id", item_words(F.col("text")).alias("w"))
    marks = [_tagged(winnowed(F.col("w"), m), m) for m in lengths]
    marks = F.concat(*marks) if marks else F.array().cast("array<struct<m:int,h:bigint>>")
    prints = tokens.select("doc_id", F.explode(marks).alias("p")).select("doc_id", "p.m", "p.h")
    # n_windows bounds the number of kept hashes: one a window.
    found = prints.join(small(keys, n_windows), (F.col("m") == F.col("km")) & (F.col("h") == F.col("kh"))).select("doc_id", "m", "h")
    found = stored(found.groupBy("doc_id").agg(F.collect_set(F.struct("m", "h")).alias("prints")), "bench-found")
    size = found.agg(F.sum(F.size("prints")).alias("n")).first()["n"] or 0
    # 2. Windows around common hashes, by their words.
    side = small(found.withColumnRenamed("doc_id", "found_id"), size)
    both = docs.join(side, docs["doc_id"].eqNullSafe(F.col("found_id")), "left").select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("w"), "prints")
    cut = F.array().cast("array<struct<s:int,m:int,gram:string>>")
    for m in lengths:
        cut = F.concat(cut, _windows_around(F.col("w"), _hashes_of(F.col("prints"), m), m))
    narrow = both.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.when(F.col("prints").isNotNull(), cut).alias("cut"))
    narrow = stored(narrow, "bench-narrow")
    exact = narrow.where("cut IS NOT NULL").select("doc_id", "text_hash", F.explode("cut").alias("c")).select("doc_id", "text_hash", "c.s", "c.m", "c.gram")
    exact = exact.join(small(distinct, n_windows), ["m", "gram"]).groupBy("doc_id", "text_hash")
    exact = exact.agg(hit_words(F.array_sort(F.collect_set(F.struct("s", "m")))).alias("n_hit"), F.collect_set("item_set").alias("sets"))
    sets = table.groupBy("item_set").agg(F.any_value("items").alias("items"))
    named = exact.select("doc_id", "text_hash", "n_hit", F.explode("sets").alias("item_set")).join(small(sets, n_sets), "item_set")
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    result = named.groupBy("doc_id", "text_hash").agg(F.any_value("n_hit").alias("n_hit"), united.alias("items"))
    result = result.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "n_hit", "items")
    out = narrow.select("doc_id", "text_hash", "n_words").join(result, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _windows_around(words: Column, hashes: Column, m: int) -> Column:
    """array<struct<s, m, gram>> of the windows of m words that hold a gram with one of the hashes."""
    k = min(GRAM, m)
    run = m - k + 1

    def cut(w):
        at = let(hashes, lambda own: F.filter(F.transform(gram_hashes(w, k), lambda h, i: F.when(F.array_contains(own, h), i)), lambda i: i.isNotNull()))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(F.lit(0), i - (run - 1)), F.least(i, F.size(w) - m), F.lit(1)))))
        return F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(m).alias("m"), F.array_join(F.slice(w, s + 1, m), " ").alias("gram")))

    return F.when((F.size(words) >= m) & (F.size(hashes) > 0), let(words, cut)).otherwise(F.array().cast("array<struct<s:int,m:int,gram:string>>"))


def decontamination(documents: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated: one row a document."""
    out = matches(documents, benchmark, **columns)
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, min_hit: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents with fewer than min_hit hit words."""
    bad = matches(documents, benchmark, id_col, text_col).where(F.col("n_hit") >= min_hit).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad = stored(bad, "bench-bad")
    return documents.join(small(bad, bad.count()), documents[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(documents[text_col]) == F.col("__hash")), "left_anti")
