"""Removal of repeated passages by fixed-block anchors.

Every document's non-overlapping blocks of BLOCK words are the index; every rolling run of BLOCK words probes it.
A passage of WINDOW >= 2 * BLOCK - 1 words always holds a whole block of the document it was first seen in, so
each repeat of such a passage has a hit. Hits are extended: all windows of WINDOW words around a hit are compared
exactly (96-bit hashes of the words), and a word is removed if it lies in a window that also starts in a document
with a smaller id. Runs of such windows are the maximal exact repeats.

Both comparisons run alike. A task gathers a batch of documents; equal runs inside the batch meet there, and only
one entry a distinct run and batch is sent on, with the batch's least document (so a passage that a third of all
documents share costs one entry a batch). Entries travel packed: sorted 48-bit hashes, with a table of the
document ids, in one row a batch and bucket. Buckets are ranges of the hash; one bucket is one group of the shuffle. There
is one for every BUCKET_BYTES of text, so what a task gathers does not grow with the input.
The text is shuffled once, by id and compressed; both joins with it reuse that exchange.

Ids that are no integers are numbered in their order first (a range-partitioned sort of the distinct ids).

Defined cases: null and empty texts have no words; documents shorter than WINDOW keep all words; rows with equal
ids do not remove each other's words; null ids are neither compared nor cut; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm.hashing import mixed, run_hashes, word_hashes, words_of
from siltstone.llm.shared import only_columns, ship, stored

WINDOW, BLOCK = 50, 25
#: Runs gathered before a batch is sent on.
BATCH = 600_000
#: Bytes of text for which there is one bucket, and one part of the texts.
BUCKET_BYTES, PART_BYTES = 4 << 20, 64 << 20
_BITS = 48
_PACKED = "bucket int, kind int, docs binary, doc_at binary, high binary, low binary, more binary, flags binary"
_FIELDS = ["bucket", "kind", "docs", "doc_at", "high", "low", "more", "flags"]
ENTRY, KNOWN = 0, 1


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _BITS)


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """One 64-bit key of two 48-bit hashes, to find a document's own windows again."""
    return (one << np.uint64(16)) ^ (two * np.uint64(0x9E3779B97F4A7C15))


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids as the first one and small differences, where these fit."""
    steps = np.diff(ids)
    if len(steps) and 0 <= steps.min() and steps.max() < 1 << 32:
        return b"d" + ids[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"r" + ids.tobytes()


def _unpack_ids(data: bytes) -> np.ndarray:
    if data[:1] == b"r":
        return np.frombuffer(data, np.int64, offset=1)
    first = np.frombuffer(data, np.int64, 1, 1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(data, np.uint32, offset=9).astype(np.int64))])


class _Batch:
    """Runs of a batch of documents; `exact` batches carry a second hash and look for smaller ids only."""

    def __init__(self, buckets: int, exact: bool):
        self.buckets, self.exact = buckets, exact
        self.clear()

    def clear(self):
        self.ids, self.one, self.two, self.flags, self.size = [], [], [], [], 0

    def add(self, doc: int, one: np.ndarray, two: np.ndarray | None, flags: np.ndarray | None) -> None:
        self.ids.append(doc)
        self.one.append(one)
        self.two.append(two)
        self.flags.append(flags)
        self.size += len(one)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.clear()
            return
        order = sorted(range(len(self.ids)), key=self.ids.__getitem__)
        ids = np.array([self.ids[i] for i in order], np.int64)
        one = np.concatenate([self.one[i] for i in order])
        doc = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(self.one[i]) for i in order])
        if self.exact:
            two = np.concatenate([self.two[i] for i in order])
            by = np.lexsort((two, one))
            one, two, doc = one[by], two[by], doc[by]
            new = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        else:
            flags = np.concatenate([self.flags[i] for i in order])
            by = np.argsort(one, kind="stable")
            one, doc, flags = one[by], doc[by], flags[by]
            new = one[1:] != one[:-1]
        starts = np.flatnonzero(np.concatenate([[True], new]))
        counts = np.diff(np.append(starts, len(one)))
        first = ids[doc[starts]]
        # Documents that the batch itself decides: exact: a smaller id has the run; else: any other id has it.
        owner = np.repeat(first, counts)
        if self.exact:
            known = ids[doc] > owner
            keys = _joined(one, two)
        else:
            known = np.repeat(np.maximum.reduceat(ids[doc], starts) > first, counts)
            keys = one
        yield from self._known(ids, doc[known], keys[known])
        low = one[starts]
        bucket = ((low >> np.uint64(16)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        at = doc[starts]
        flag = two[starts] if self.exact else np.logical_or.reduceat(flags, starts)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[b], cuts[b + 1])
            own, where = np.unique(at[s], return_inverse=True)
            where = where.astype(np.uint16 if len(own) <= 65536 else np.uint32)
            yield self._row(
                b, ENTRY, _pack_ids(ids[own]), where, (low[s] >> np.uint64(32)).astype(np.uint16), (low[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                ((flag[s] >> np.uint64(32)).astype(np.uint16).tobytes() + (flag[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()) if self.exact else b"",
                b"" if self.exact else np.packbits(flag[s]).tobytes(),
            )
        self.clear()

    def _known(self, ids: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(doc):
            return
        by = np.argsort(doc, kind="stable")
        doc, keys = doc[by], keys[by]
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True):
            yield self._row(int(doc[a]) % self.buckets, KNOWN, _pack_ids(ids[doc[a : a + 1]]), b"", b"", np.unique(keys[a:b]), b"", b"")

    @staticmethod
    def _row(bucket: int, kind: int, *columns) -> pa.RecordBatch:
        data = [pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *data], _FIELDS)


def _merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger record batches: one message a few megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += r.nbytes
        if size > 4_000_000 or len(held) >= 2000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_ANSWER = "part int, d binary, counts binary, keys binary"


def _answers(doc: np.ndarray, keys: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row a part of the documents' ids: the documents, how many keys each has, the keys."""
    part = (mixed(doc.astype(np.uint64)) >> np.uint64(32)) % np.uint64(parts)
    by = np.lexsort((doc, part))
    doc, keys, part = doc[by], keys[by], part[by]
    change = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    starts = change(doc)
    counts = np.diff(np.append(starts, len(doc)))
    cuts = [*change(part[starts]).tolist(), len(starts)]
    rows: list[tuple] = []
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        low, high = starts[a], starts[b] if b < len(starts) else len(doc)
        rows.append((int(part[low]), doc[starts[a:b]].tobytes(), counts[a:b].astype(np.uint32).tobytes(), keys[low:high].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "d", "counts", "keys"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of one part to one row a document."""
    docs, keys = [], []
    for batch in batches:
        for d, n, k in zip(batch.column("d").to_pylist(), batch.column("counts").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint32)))
            keys.append(np.frombuffer(k, np.uint64))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    by = np.argsort(doc, kind="stable")
    doc, key = doc[by], key[by]
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = [*starts[1:].tolist(), len(doc)]
    for at in range(0, len(starts), 2000):
        span = slice(at, at + 2000)
        yield pa.RecordBatch.from_arrays([pa.array(doc[starts[span]]), pa.array([key[a:b].tobytes() for a, b in zip(starts[span].tolist(), ends[span], strict=True)], pa.binary())], ["d", "keys"])


def _meet(exact: bool, parts: int):
    """Reducer of one bucket: which documents' runs count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, one, two, flags, found, answers = [], [], [], [], [], []
        for batch in batches:
            columns = {n: batch.column(n) for n in _FIELDS[1:]}
            for i in range(batch.num_rows):
                get = lambda n, i=i: columns[n][i].as_py()  # noqa: B023
                ids = _unpack_ids(get("docs"))
                if get("kind") == KNOWN:
                    answers.append(np.frombuffer(get("low"), np.uint64))
                    found.append(np.full(len(answers[-1]), ids[0]))
                    continue
                low = np.frombuffer(get("low"), np.uint32).astype(np.uint64)
                n = len(low)
                at = get("doc_at")
                docs.append(ids[np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)])
                one.append(np.frombuffer(get("high"), np.uint16).astype(np.uint64) << np.uint64(32) | low)
                if exact:
                    more = get("more")
                    two.append(np.frombuffer(more, np.uint16, n).astype(np.uint64) << np.uint64(32) | np.frombuffer(more, np.uint32, n, 2 * n))
                else:
                    flags.append(np.unpackbits(np.frombuffer(get("flags"), np.uint8), count=n).astype(bool))
        if docs:
            doc, h = np.concatenate(docs), np.concatenate(one)
            del docs, one
            if exact:
                h2 = np.concatenate(two)
                by = np.lexsort((doc, h2, h))
                doc, h, h2 = doc[by], h[by], h2[by]
                starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))
                hit = doc > np.repeat(doc[starts], np.diff(np.append(starts, len(h))))
                found.append(doc[hit])
                answers.append(_joined(h[hit], h2[hit]))
            else:
                f = np.concatenate(flags)
                by = np.argsort(h, kind="stable")
                doc, h, f = doc[by], h[by], f[by]
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                counts = np.diff(np.append(starts, len(h)))
                hit = np.repeat((counts > 1) & np.logical_or.reduceat(f, starts), counts)
                found.append(doc[hit])
                answers.append(h[hit])
        yield _answers(np.concatenate(found), np.concatenate(answers), parts)

    return run


def _keys(cell) -> np.ndarray:
    return np.frombuffer(cell.as_py() or b"", np.uint64)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed UTF-8, for the shuffle."""
    zip_ = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [None if t is None else zip_(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(packed, pa.binary())], ["doc_id", "name", "packed"])


def _words(cell, unzip) -> list[bytes]:
    packed = cell.as_py()
    return unzip(packed).split() if packed else []


def _probe(buckets: int, window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            batch_of = _Batch(buckets, exact=False)
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    words = words_of(text.as_py())
                    if doc is None or len(words) < window:
                        continue
                    hashes = _short(run_hashes(word_hashes(words), block))
                    aligned = np.zeros(len(hashes), bool)
                    aligned[::block] = True
                    batch_of.add(doc, hashes, None, aligned)
                    if batch_of.size >= BATCH:
                        yield from batch_of.rows()
            yield from batch_of.rows()

        return _merged(rows())

    return run


def _window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = word_hashes(words)
    return one, _short(run_hashes(one, window)), _short(run_hashes(word_hashes(words, 1), window))


def _extend(buckets: int, window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            batch_of, unzip = _Batch(buckets, exact=True), zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for doc, text, keys in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("keys"), strict=True):
                    words = _words(text, unzip)
                    if len(words) < window:
                        continue
                    base, one, two = _window_hashes(words, window)
                    hit = np.isin(_short(run_hashes(base, block)), _keys(keys))
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    near = sums[window - block + 1 : window - block + 1 + len(one)] > sums[: len(one)]
                    if near.any():
                        batch_of.add(doc, one[near], two[near], None)
                        if batch_of.size >= BATCH:
                            yield from batch_of.rows()
            yield from batch_of.rows()

        return _merged(rows())

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, texts = [], [], []
            for text, keys in zip(batch.column("packed"), batch.column("keys"), strict=True):
                words = _words(text, unzip)
                gone, found = 0, _keys(keys)
                if len(found) and len(words) >= window:
                    _, one, two = _window_hashes(words, window)
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.flatnonzero(np.isin(_joined(one, two), found))
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                    keep = np.cumsum(edge)[:-1] == 0
                    gone = len(words) - int(keep.sum())
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    kept = words
                sizes.append(len(words))
                removed.append(gone)
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _numbered(ids: DataFrame) -> DataFrame:
    """name, number: the distinct ids (name) numbered in their order. Places inside a part are fixed by writing them."""
    kind = ids.schema["name"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))], ["name", "part", "at"])
            done += n

    rows = ids.where("name IS NOT NULL").distinct().repartitionByRange("name").sortWithinPartitions("name")
    rows = stored(rows.mapInArrow(place, f"name {kind}, part int, at long"), "substring-ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(sizes), F.col("part") == F.col("p")).select(F.col("name").alias("known"), (F.col("offset") + F.col("at")).alias("number"))


def substring_dedup(df: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one blank): one row a row of df."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it stands")
    spark = df.sparkSession
    ship(spark)
    docs = only_columns(df, id_col, text_col).toDF("name", "text")
    if isinstance(docs.schema["name"].dataType, T.IntegralType):
        docs = docs.select(F.col("name").cast("long").alias("doc_id"), F.col("name").cast("long"), "text")
    else:
        docs = docs.join(_numbered(docs.select("name")), F.col("name") == F.col("known"), "left").select(F.col("number").alias("doc_id"), "name", "text")
    name = f"name {docs.schema['name'].dataType.simpleString()}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = -(-size // BUCKET_BYTES) or 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES), 1)
    packed = docs.mapInArrow(_squeeze, f"doc_id long, {name}, packed binary")
    # Without null ids both joins want the same rows of it, so that the second one reuses the first one's shuffle.
    by_id = packed.where("doc_id IS NOT NULL").repartition(parts, "doc_id")
    nameless = docs.where("doc_id IS NULL").mapInArrow(_squeeze, f"doc_id long, {name}, packed binary")

    def met(packed: DataFrame, exact: bool) -> DataFrame:
        """d, keys: one row a document with runs that count; at most 8 bytes a run."""
        answers = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet(exact, parts), _ANSWER)
        return answers.groupBy("part").applyInArrow(_unpack, "d long, keys binary")

    hits = met(docs.mapInArrow(_probe(buckets, window, block), _PACKED), exact=False)
    # The same columns of by_id in both joins, else its shuffle would not be reused.
    near = by_id.join(hits, F.col("doc_id") == F.col("d")).select("doc_id", "name", "packed", "keys")
    repeats = met(near.mapInArrow(_extend(buckets, window, block), _PACKED), exact=True)
    out = by_id.join(repeats, F.col("doc_id") == F.col("d"), "left").select("doc_id", "name", "packed", "keys")
    out = out.unionByName(nameless.withColumn("keys", F.lit(None).cast("binary")))
    return out.mapInArrow(_cut(window), f"doc_id {name.split(' ', 1)[1]}, n_words long, n_removed long, kept_sha256 string, kept_text string")
