"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Instead of tables * 4 minhashes a document, two collections of SIDE pairs of minhashes are computed: u_1..u_SIDE
and v_1..v_SIDE. Table (i, j) has the key (u_i, v_j): SIDE * SIDE tables from 4 * SIDE minhashes. A pair of
similarity s meets in some table with probability (1 - (1 - s^2)^SIDE)^2: at least 0.9999 from s = 0.8 on with
SIDE = 10.

1. One scan gives each document its shingle count, a 128-bit fingerprint of its set and its minhashes. Equal
   sets form a class, and only classes go on, so exact copies cost one row each.
2. Rows of tables with a single member drop out by an aggregation by key. In the other tables every member is
   paired with the table's least member, never with all others.
3. Pairs are confirmed on full sets and linked. First each member with the least of its tables; then, among pairs
   whose ends are not yet in one component, the remaining pairs with tables' least members. To be compared, the partners of a
   set that many pairs name come to it in blocks of HUB or so; it is sent once a block, not once a pair.
4. Tables that still hold several components are settled exactly, without pairing their members: each member sends
   its rarest shingles, so many that two sets of the wanted similarity must share one, and only members of different
   components that do share one, and whose sizes and places in the order allow a link, are paired. Of two such sets the smaller
   one must have the shingle among still fewer of its rarest ones (it is looked up, the larger one looks up); a passage that a
   family of documents shares without being similar enough has no such place, so it pairs nobody. Shingles that very
   many sets send are cut into a grid of cells of CELL by CELL rows, so none is one task's work. Rarity is judged by
   counts in a fixed number of hash buckets (RARITY); any order that is the same for all sets is right, this one keeps common
   passages out. So a passage that thousands of documents share, or a group of near copies, gives no pairs in the
   square of its size.

Shingles are compared as 64-bit hashes. Defined cases: documents without words have no shingles, no links and are
kept; one with fewer words than a shingle has its word sequence as its only shingle; rows with equal ids are one
document, with the links of all its texts (each row has the shingle count of its own text; a row without words stays alone
whatever its id); ids may be of any type that can be ordered; a null id is its own component (null) and kept; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.components import connected_components
from siltstone.llm.hashing import mixed, run_hashes, word_hashes, words_of
from siltstone.llm.shared import forget, large, only_columns, ship, small, stored

SIDE = 10
#: Buckets of shingle counts; what the driver holds and broadcasts is 4 bytes each (8 MB), at any size of the input.
RARITY, PAGE = 1 << 21, 1 << 10
#: Partners that are compared with one sending of a set; rows of a shared shingle that meet in one cell.
HUB, CELL = 256, 4096
_rng = np.random.default_rng(20240517)
_XOR = _rng.integers(0, 1 << 63, 4 * SIDE, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 4 * SIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes([w.lower() for w in words])
    if len(words) < width:
        return run_hashes(hashes, len(words)) ^ np.uint64(len(words))
    return np.unique(run_hashes(hashes, width))


def pair_hashes(shingles: np.ndarray) -> np.ndarray:
    """u_1..u_SIDE, v_1..v_SIDE of a set: each joins two minhashes."""
    least = np.full(4 * SIDE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    return mixed(least[0::2] * np.uint64(0x9E3779B97F4A7C15) + mixed(least[1::2]))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fp (null if there is no shingle), groups of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, prints, groups = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                counts.append(len(s))
                prints.append(md5(s.tobytes()).digest() if len(s) else None)
                groups.append(pair_hashes(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(groups, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp", "groups"]
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, fp binary, groups array<long>")


def _table_rows(classes: DataFrame) -> DataFrame:
    """key, cls: one row a table of each class; keys are hashes of (i, j, u_i, v_j)."""
    rows = classes.select("cls", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("t"), "groups")
    i, j = F.floor(F.col("t") / SIDE).cast("int"), F.col("t") % SIDE
    return rows.select(F.xxhash64("t", F.get("groups", i), F.get("groups", j + SIDE)).alias("key"), "cls")


def _members(classes: DataFrame, shared: DataFrame, n_shared: int) -> DataFrame:
    """key, cls, least of the rows of the tables k that several classes share. Spark sizes the rows of tables by their classes, though
    there are SIDE * SIDE a class, so by itself it may broadcast them all."""
    rows = _table_rows(classes)
    return large(rows, n_shared).join(small(shared, n_shared), F.col("key") == F.col("k")).select("key", "cls", "least")


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Do two sorted sets reach the similarity?"""
    small_set, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small_set) or 100 * len(small_set) < percent * len(large):
        return False
    at = np.searchsorted(large, small_set)
    common = int((large[np.minimum(at, len(large) - 1)] == small_set).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


class _Confirm:
    """Confirms candidate pairs of classes on their full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.percent = percent
        need = stored(classes.select("cls", F.col("rep").alias("need"), F.col("fp").alias("want")), "near-need")
        rows = docs.join(small(need, need.count()), F.col("doc_id") == F.col("need")).select("cls", "want", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, sets = [], []
                for cls, want, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    s = shingle_set(text.as_py(), width).tobytes()
                    if md5(s).digest() == want:  # an id may bear other texts too
                        ids.append(cls)
                        sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

        self.sets = stored(rows.mapInArrow(run, "id long, set binary").dropDuplicates(["id"]), "near-sets")
        forget(need)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        percent = self.percent
        pairs = stored(pairs.select("a", "b"), "near-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("hub")).groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB)
        ends = stored(ends, "near-hubs")
        n_ends = ends.count()
        one = small(ends.select(F.col("hub").alias("h1"), F.col("n").alias("n1")), n_ends)
        two = small(ends.select(F.col("hub").alias("h2"), F.col("n").alias("n2")), n_ends)
        both = pairs.join(one, F.col("a") == F.col("h1"), "left").join(two, F.col("b") == F.col("h2"), "left")
        turn = F.coalesce("n2", F.lit(0)) > F.coalesce("n1", F.lit(0))  # the one in more pairs stays, the other comes
        other = F.when(turn, F.col("a")).otherwise(F.col("b"))
        dealt = both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("hub"), other.alias("other"), F.pmod(F.xxhash64(other), F.ceil(F.greatest(F.coalesce("n1", F.lit(1)), F.coalesce("n2", F.lit(1))) / HUB)).alias("block"))
        dealt = stored(dealt, "near-dealt")
        n_dealt = dealt.count()  # its file is small for its rows, and Spark goes by the file
        come = small(large(dealt, n_dealt), n_dealt).join(self.sets, F.col("other") == F.col("id")).select("hub", "block", F.lit(1).alias("kind"), "id", "set")
        stay = dealt.select("hub", "block").distinct().join(self.sets, F.col("hub") == F.col("id")).select("hub", "block", F.lit(0).alias("kind"), "id", "set")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, of = np.zeros(0, np.uint64), None
            for batch in batches:
                found = []
                for hub, kind, other, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    s = np.frombuffer(data.as_buffer(), np.uint64)
                    if kind == 0:
                        held, of = s.copy(), hub
                    elif of == hub and similar(held, s, percent):
                        found.append((hub, other))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        rows = come.unionByName(stay).repartition("hub", "block").sortWithinPartitions("hub", "block", "kind")
        links = stored(rows.select("hub", "kind", "id", "set").mapInArrow(run, "a long, b long"), "near-links")
        forget(pairs, ends, dealt)
        return links


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    one = components.select(F.col("node").alias("n1"), F.col("component").alias("c1"))
    two = components.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
    out = pairs.join(one, F.col("a") == F.col("n1"), "left").join(two, F.col("b") == F.col("n2"), "left")
    return out.where(F.coalesce("c1", "a") != F.coalesce("c2", "b")).select("a", "b")


def _sharing_rare(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a, b: members of different components that share one of their rarest shingles and may be similar enough."""
    own = sets.join(small(members, members.count()), F.col("id") == F.col("cls")).select("id", "c", "set")
    shift = np.uint64(64 - (RARITY.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            total += np.bincount((held >> shift).astype(np.int64), minlength=RARITY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, counts = 0, np.zeros(PAGE, np.int32)
        for batch in batches:
            at = batch.column("bucket").to_numpy()
            page = int(at[0]) // PAGE if len(at) else page
            counts[at % PAGE] = np.minimum(batch.column("n").to_numpy(), np.iinfo(np.int32).max)
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["page", "counts"])

    counted = own.select("set").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    pages = counted.groupBy(F.floor(F.col("bucket") / PAGE).alias("p")).applyInArrow(dense, "page int, counts binary")
    table = np.zeros(RARITY, np.int32)
    for r in pages.collect():  # RARITY counts of 4 bytes at most
        table[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.frombuffer(r["counts"], np.int32)
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners, sizes, places = [], [], [], []
            for i, cell in enumerate(batch.column(2)):
                s = np.frombuffer(cell.as_py(), np.uint64)
                want = len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, shared.value[(s >> shift).astype(np.int64)]))[:want]
                hashes.append(s[order].view(np.int64))
                owners.append(np.full(len(order), i))
                sizes.append(np.full(len(order), len(s), np.int64))
                places.append(np.arange(len(order)))
            owner = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(hashes)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(flat(sizes)), pa.array(flat(places))], ["h", "id", "c", "n", "i"])

    # Of a pair, the smaller set (on ties the one of smaller number) is looked up. If a pair's first common shingle stands at
    # places i and j, at most the rest from there on is common to both; later common ones allow less. So a set is looked
    # up only by shingles from whose place on enough could be common with a set as large as itself.
    rare = own.mapInArrow(rarest, "h long, id long, c long, n long, i long").withColumn("low", (100 + percent) * (F.col("n") - F.col("i")) >= 2 * percent * F.col("n"))
    rare = stored(rare, "near-rare")
    # A shingle that one component alone sends, or by which none is looked up, pairs nothing.
    lively = rare.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("low"), 1)).alias("n_low")).where("c1 <> c2 AND n_low > 0")
    lively = lively.select(F.col("h").alias("k"), F.ceil(F.col("n") / CELL).cast("int").alias("n_high"), F.ceil(F.col("n_low") / CELL).cast("int").alias("n_low"))
    rare = rare.join(lively, F.col("h") == F.col("k"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rare.where("low").select(F.col("h").alias("h1"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"), place("n_low").alias("x1"), every("n_high").alias("y1"))
    two = rare.select(F.col("h").alias("h2"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"), place("n_high").alias("y2"), every("n_low").alias("x2"))
    common = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    fits = ((100 + percent) * common >= percent * (F.col("na") + F.col("nb"))) & (100 * F.col("na") >= percent * F.col("nb"))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = one.join(two, (F.col("h1") == F.col("h2")) & (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2")) & (F.col("ca") != F.col("cb")) & order & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _one_document(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids that bear several texts."""
    mark = F.xxhash64("fp")
    twice = stored(known.groupBy("doc_id").agg(F.min(mark).alias("m1"), F.max(mark).alias("m2")).where("m1 <> m2").select(F.col("doc_id").alias("twice"), "m1"), "near-twice")
    n = twice.count()
    rows = known.join(small(twice, n), F.col("doc_id") == F.col("twice")).select("twice", "m1", F.col("fp").alias("f")).distinct()
    rows = rows.join(classes.select("fp", "cls"), F.col("f") == F.col("fp")).select("twice", (F.xxhash64("f") == F.col("m1")).alias("first"), "cls")
    rows = stored(rows, "near-texts")
    first = rows.where("first").groupBy("twice").agg(F.min("cls").alias("a"))
    out = rows.join(first, "twice").where(F.col("cls") != F.col("a")).select("a", F.col("cls").alias("b"))
    out = stored(out, "near-same")
    forget(twice, rows)
    return out


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    ship(df.sparkSession)
    docs = only_columns(df, id_col, text_col).toDF("doc_id", "text")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sigs = stored(signatures(docs, width), "near-signatures")
    known = sigs.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    # Classes are numbered when they are written, so the numbers hold from then on; in the order of ids, as originals tend to
    # come before what was made from them, and tables' least members should be originals.
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.any_value("groups").alias("groups"))
    classes = classes.orderBy("rep").withColumn("cls", F.monotonically_increasing_id())
    classes = stored(classes, "near-classes")
    rows = _table_rows(classes)
    shared = stored(rows.groupBy("key").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "least"), "near-tables")
    members = stored(_members(classes, shared, shared.count()), "near-members")
    stars = members.where("cls <> least").groupBy("cls", "least").agg(F.count(F.lit(1)).alias("n")).select(F.col("least").alias("a"), F.col("cls").alias("b"))
    stars = stored(stars, "near-stars")
    ids = members.select(F.col("cls").alias("id")).distinct()
    confirm = _Confirm(docs, classes.join(ids, F.col("cls") == F.col("id"), "left_semi"), width, percent)
    first = stored(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-first")
    links = [_one_document(known, classes), confirm(first)]

    def joined() -> DataFrame:
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        return stored(connected_components(edges), "near-components")

    found = [joined()]
    links.append(confirm(_apart(stars.join(first, ["a", "b"], "left_anti"), found[-1])))
    found.append(joined())
    # Tables that still hold members of two components or more.
    marked = members.join(found[-1], F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("c"))
    mixed_keys = marked.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select(F.col("key").alias("k"))
    open_members = stored(marked.join(mixed_keys, F.col("key") == F.col("k")).select("cls", "c").distinct(), "near-open")
    links.append(confirm(_sharing_rare(confirm.sets, open_members, percent).join(stars, ["a", "b"], "left_anti")))
    if not links[-1].isEmpty():
        found.append(joined())
    # A component's name is the least id of its classes.
    linked = found[-1].join(classes.select("cls", "rep"), F.col("node") == F.col("cls")).select("cls", "component", "rep")
    names = stored(linked.groupBy("component").agg(F.min("rep").alias("name")), "near-names")
    named = linked.join(small(names, names.count()), "component").select(F.col("cls").alias("own"), "name")
    by_class = classes.join(named, F.col("cls") == F.col("own"), "left").select(F.col("fp").alias("f"), F.coalesce("name", "rep").alias("component_id"))
    by_class = stored(by_class, "near-result")
    forget(classes, shared, members, stars, first, open_members, names, confirm.sets, *links, *found)
    linked = known.join(by_class, F.col("fp") == F.col("f")).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("fp IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose document is the least of its group."""
    gone = stored(near_duplicates(df, width, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    return df.join(small(gone, gone.count()), df[id_col] == F.col("__gone"), "left_anti")
