"""Ranked lexical search: document-sharded CSR postings with precomputed integer impacts, scored term at a time.

Documents are dealt into shards of a bounded number of documents and terms. A shard is one row: its distinct terms in
order, and for each term the places of its documents within the shard (in order of doc_id) with an impact, a whole number
that holds all of the score but the term's weight and so needs nothing but the corpus's two totals. A search adds, for
each item and one term after another, weight times impact into a dense array with a place for each document, takes
the k best by argpartition with ties told by doc_id, and merges the best of a task's shards before anything is shuffled.

Items travel in blocks of a bounded number of terms, which are sent to the tasks one group of blocks after another, so their
number is not bounded; each group reads the index once. Weights come from document frequencies summed over all shards, for
the items' terms alone.

Defined results: null texts and texts without a term are documents of no length, which are neither counted nor found; a null
doc_id is a document like others, placed after all others at equal scores; rows that repeat a doc_id are documents of
their own; each row of items is searched by itself, repeated ones too; null or termless items find nothing; very long texts
are read whole, piece by piece; empty tables find nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, parts, written

#: Documents and terms (with repeats) of a shard; a longer document is a shard of its own.
SHARD_DOCS, SHARD_TERMS = 8192, 1 << 20
#: Items and distinct terms of a block, and the terms of the blocks that are sent out together (some 40 bytes each).
BLOCK_ITEMS, BLOCK_TERMS, SENT_TERMS = 256, 1 << 15, 1 << 19
#: Bytes of a text that are split at a time.
PIECE = 1 << 22
#: Groups that the tasks' best are merged in before the last merge.
MERGES = 64
#: Fixed values of the score: thousandths of a weight, the scale of an impact, and the damping of frequency by length.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_BASE, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 12, 100, 25
#: Digits, letters and all bytes of other alphabets stay, A-Z in lower case; every other ASCII character parts terms.
_CLEAN = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_SHARD = "ids array<long>, terms array<binary>, starts binary, places binary, impacts binary, dfs array<int>"
_FOUND = "item long, item_id long, doc_id long, score long"


def _terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of those of a piece."""
    text = text or b""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_CLEAN)
        at += PIECE
        while at < len(text) and piece[-1] != 32:  # a piece ends where a term does
            more = text[at : at + 256].translate(_CLEAN)
            end = more.find(b" ") + 1 or len(more)
            piece += more[:end]
            at += end
        yield piece.split()


def _texts(part: pa.RecordBatch, name: str) -> list[bytes | None]:
    return part[name].cast(pa.binary()).to_pylist()


def lengths(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats) of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for part in parts(batches):
            for text in _texts(part, "text"):
                size = sum(map(len, _terms(text)))
                n, total = n + (size > 0), total + size
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    bound_batches(docs.sparkSession)
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return sums[0] or 0, sums[1] or 0


def _shard(docs: list[tuple[int | None, np.ndarray]], vocabulary: dict[bytes, int], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The CSR postings of documents (doc_id, numbers of their terms)."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    words = sorted(vocabulary)
    place = np.empty(len(words), np.int64)
    place[[vocabulary[w] for w in words]] = np.arange(len(words))
    size = np.array([len(ids) for _, ids in docs])
    key, tf = np.unique(place[np.concatenate([ids for _, ids in docs])] * len(docs) + np.repeat(np.arange(len(docs)), size), return_counts=True)
    term, doc = np.divmod(key, len(docs))
    starts = np.searchsorted(term, np.arange(len(words) + 1)).astype("<i4")
    m = np.array([LENGTH_BASE - LENGTH_SHARE + LENGTH_SHARE * int(n) * n_docs // n_terms for n in size])
    impact = IMPACT_SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m[doc])
    cells = [[d for d, _ in docs], words, starts.tobytes(), doc.astype("<i4").tobytes(), impact.astype("<i4").tobytes(), np.diff(starts)]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["ids", "terms", "starts", "places", "impacts", "dfs"])


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """(shards, documents with a term) from docs (doc_id, text); the shards are a written table that any number of searches read."""
    n_docs, n_terms = lengths(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, terms = [], 0
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        for part in parts(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), _texts(part, "text")):
                ids = [np.fromiter(map(vocabulary.__getitem__, piece), np.int32, len(piece)) for piece in _terms(text)]
                ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
                if not len(ids):
                    continue
                held.append((doc_id, ids))
                terms += len(ids)
                if len(held) >= SHARD_DOCS or terms >= SHARD_TERMS:
                    yield _shard(held, vocabulary, n_docs, n_terms)
                    held, terms, vocabulary = [], 0, defaultdict(count().__next__)
        if held:
            yield _shard(held, vocabulary, n_docs, n_terms)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, _SHARD), "shards"), n_docs


def _blocks(items: DataFrame) -> DataFrame:
    """(ids, terms, starts, places, times): CSR blocks of items (item_id, text), each with at most BLOCK_ITEMS or little over BLOCK_TERMS terms."""

    def block(held: list[tuple[int | None, Counter]]) -> pa.RecordBatch:
        by_term = defaultdict(list)
        for k, (_, terms) in enumerate(held):
            for term, n in terms.items():
                by_term[term].append((k, n))
        words = sorted(by_term)
        pairs = [p for w in words for p in by_term[w]]
        starts = np.cumsum([0, *(len(by_term[w]) for w in words)]).tolist()
        cells = [[i for i, _ in held], words, starts, [k for k, _ in pairs], [n for _, n in pairs]]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(k)) for c, k in zip(cells, kinds)], ["ids", "terms", "starts", "places", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts(batches):
            for item_id, text in zip(part["item_id"].to_pylist(), _texts(part, "text")):
                terms: Counter = Counter()
                for piece in _terms(text):
                    terms.update(piece)
                if terms:
                    held.append((item_id, terms))
                    size += len(terms)
                if len(held) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "ids array<long>, terms array<binary>, starts array<int>, places array<int>, times array<long>")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores over 0, the highest first and equal ones by place."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        mine = scores[some]
        least = mine[np.argpartition(mine, len(mine) - k)[len(mine) - k]]
        over = some[mine > least]
        some = np.concatenate([over, some[mine == least][: k - len(over)]])
    return some[np.lexsort((some, -scores[some]))]


def _merged(found: dict[int, tuple[np.ndarray, np.ndarray]], item: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Adds the best of a shard to those of an item, kept by score and then id; a null id is the largest."""
    if item in found:
        ids, scores = np.concatenate([found[item][0], ids]), np.concatenate([found[item][1], scores])
    top = np.lexsort((ids, -scores))[:k]
    found[item] = ids[top], scores[top]


def search(shards: DataFrame, n_docs: int, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of `index` for each row of items (item_id, text)."""
    spark = shards.sparkSession
    blocks = written(_blocks(items), "blocks")
    wanted = blocks.select(F.explode("terms").alias("term")).distinct()
    df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = df.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df") + 1)))
    # each block gets the weights of its own terms, null for those of no document
    numbered = blocks.withColumn("block", F.monotonically_increasing_id())
    numbered = written(numbered, "numbered")
    of = numbered.select("block", F.posexplode("terms").alias("at", "term")).join(df.select("term", weight.alias("w")), "term", "left")
    of = of.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("weights"))  # little over BLOCK_TERMS at most
    ready = written(numbered.join(of, "block"), "ready")

    def scored(sent: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(sent)  # little over SENT_TERMS terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            top = np.iinfo(np.int64).max
            for part in parts(batches):
                for row in part.to_pylist():
                    place = {t: i for i, t in enumerate(row["terms"])}
                    starts, docs, impacts = (np.frombuffer(row[c], "<i4") for c in ("starts", "places", "impacts"))
                    ids = np.array([top if d is None else d for d in row["ids"]], np.int64)
                    for first, (_, terms, begin, items_of, times, weights) in shared.value:
                        per: dict[int, list[tuple[int, int]]] = defaultdict(list)
                        for t, term in enumerate(terms):
                            if weights[t] and term in place:
                                for j in range(begin[t], begin[t + 1]):
                                    per[items_of[j]].append((place[term], weights[t] * times[j]))
                        for item, mine in per.items():
                            acc = np.zeros(len(ids), np.int64)
                            for p, w in mine:
                                span = slice(starts[p], starts[p + 1])
                                acc[docs[span]] += w * impacts[span].astype(np.int64)
                            at = best(acc, k)
                            if len(at):
                                _merged(found, first + item, ids[at], acc[at], k)
            names = {first + i: x for first, b in shared.value for i, x in enumerate(b[0])}
            for item, (ids, scores) in found.items():
                n = len(ids)
                docs = pa.array([None if d == top else d for d in ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([names[item]] * n, pa.int64()), docs, pa.array(scores)], ["item", "item_id", "doc_id", "score"])

        return shards.select("ids", "terms", "starts", "places", "impacts").mapInArrow(run, _FOUND).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGES)))

    out, sent, size, first = None, [], 0, 0
    for row in ready.toLocalIterator():
        sent.append((first, (row.ids, [bytes(t) for t in row.terms], row.starts, row.places, row.times, row.weights)))
        size, first = size + len(row.terms), first + len(row.ids)
        if size >= SENT_TERMS:
            out, sent, size = _with(out, written(scored(sent), "found")), [], 0
    if sent or out is None:
        out = _with(out, scored(sent))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    nearly = out.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    final = nearly.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return final.select("item_id", "rank", "doc_id", "score")


def _with(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else out.unionByName(more)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    shards, n_docs = index(docs)
    return search(shards, n_docs, items)
