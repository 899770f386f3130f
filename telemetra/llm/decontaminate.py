"""Benchmark decontamination by spaced seeds.

Each mask of MASKS reads some of the tokens of a window and ignores the others, so a window with substituted
tokens still gives the same hash under a mask that ignores them. Hashes of benchmark items are joined with those
of documents; around each hit item and document are compared token by token along the hit's diagonal, and a
document is contaminated if a run of min(RUN, item length) tokens agrees in SHARE of its places or more.

Every document's hashes first meet a filter of bits, one or more set by each hash of the benchmark, and only those
that pass reach the join, which removes what passed by chance; so the text that crosses a shuffle is that of documents
with hits, once each, whatever the size of the benchmark. Hits are grouped by document before they are compared.

Defined results: tokens are lower-cased runs of letters and digits; texts and items that are null or have fewer
tokens than the shortest mask have no hits; whole texts are read; repeated rows get equal results; ties go to the
smaller item id; empty tables of either kind give no overlap; other columns are carried by `clean`, whatever their
names, and ignored by `hits`. Texts are identified by their MD5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, written

#: 1 reads a token, 0 ignores it; six are read by each.
MASKS = ("111111", "110110011", "11010011001", "1011001101", "1100101011", "10110100011")
RUN, SHARE = 20, 0.8
_PLACES = [[k for k, c in enumerate(mask) if c == "1"] for mask in MASKS]
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * j + 1) % (1 << 64) for j in range(max(map(len, _PLACES)))], np.uint64)
#: Bits of the filter per benchmark hash, and the most bits in all (16 MB); with more hashes more of them pass it.
FILTER_RATIO, FILTER_BITS = 32, 1 << 27
#: Up to this number the benchmark's hashes are broadcast to the join (some 20 MB); more are joined by shuffle.
BROADCAST_HASHES = 500_000
#: Items that one row of the comparison holds at most, about; a document that meets more is given in several rows.
ITEMS_A_ROW = 256
#: Words whose hashes a task keeps; on reaching it the store is emptied.
KEPT_WORDS = 150_000
_TOKEN = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Hashes of words; emptied on reaching KEPT_WORDS."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def tokens(text: str | None, store: _Hashes | None = None) -> np.ndarray:
    """Hashes of the tokens of a text; a task's `store` keeps those of words."""
    store = _Hashes() if store is None else store
    words = _TOKEN.findall((text or "").lower())
    return np.fromiter(map(store.__getitem__, words), np.uint64, len(words))


def seeds(values: np.ndarray) -> list[np.ndarray]:
    """For each mask the hash of the window at each place: a sum of the tokens it reads, each times a number of its own."""
    with np.errstate(over="ignore"):
        times = [values * c for c in _ODD]
        out = []
        for m, places in enumerate(_PLACES):
            n = len(values) - len(MASKS[m]) + 1
            if n <= 0:
                out.append(np.empty(0, np.int64))
                continue
            acc = np.full(n, m + 1, np.uint64)
            for j, k in enumerate(places):
                acc += times[j][k : k + n]
            acc ^= acc >> np.uint64(32)
            acc *= _ODD[0]
            out.append(acc.view(np.int64))
    return out


def agreement(doc: np.ndarray, item: np.ndarray, shift: int) -> float:
    """Best share of equal tokens over windows of min(RUN, item) places, with item place i against document place i + shift."""
    width = min(RUN, len(item))
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if width == 0 or hi - lo < width:
        return 0.0
    same = np.concatenate([[0], np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])])
    return float((same[width:] - same[:-width]).max()) / width


_HIT = [("h", pa.int64()), ("key", pa.binary()), ("at", pa.int32())]


def _batch(rows: list[tuple[np.ndarray, bytes | int, np.ndarray]], fields: list) -> pa.RecordBatch:
    """Arrays of hashes and places, each with what they belong to, as one batch."""
    h = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int64)
    at = np.concatenate([r[2] for r in rows]) if rows else np.empty(0, np.int32)
    of = pa.array([r[1] for r in rows], fields[1][1]).take(pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])))
    return pa.RecordBatch.from_arrays([pa.array(h), of, pa.array(at.astype(np.int32))], [f[0] for f in fields])


def _seed_rows(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Hashes()
        for part in parts(batches):
            out = []
            for item_id, text in zip(part["item_id"].to_pylist(), part["text"].to_pylist()):
                values = tokens(text, store)
                for h in seeds(values):
                    out.append((h, item_id, np.arange(len(h), dtype=np.int32)))
            yield _batch(out, [("h", pa.int64()), ("item_id", pa.int64()), ("place", pa.int32())])

    return items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "h long, item_id long, place int")


def _filter(table: DataFrame, many: int) -> tuple[np.ndarray, int]:
    """A bit for each cell of hashes, packed into 64-bit words, and how far a hash is shifted to give its cell."""
    bits = min(FILTER_BITS, 1 << max(12, (FILTER_RATIO * many).bit_length())).bit_length() - 1
    cells = table.select(F.shiftrightunsigned("h", 64 - bits).alias("cell"))
    words = cells.groupBy(F.expr("cell >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)  # as many rows at most
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint64), 64 - bits


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, share) of confirmed overlaps; key is the MD5 of a document's text."""
    spark = docs.sparkSession
    table = written(_seed_rows(items), "seeds")
    many = table.count()
    words, shift = _filter(table, many)
    shared = spark.sparkContext.broadcast(words)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(_key().alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, down, low, store = shared.value, np.uint64(shift), np.uint64(63), _Hashes()
        for part in parts(batches):
            out = []
            for key, said in zip(part["key"].to_pylist(), part["text"].to_pylist()):
                values = tokens(said, store)
                for h in seeds(values):
                    cell = h.view(np.uint64) >> down
                    at = np.flatnonzero((known[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & low)) & np.uint64(1))
                    if len(at):
                        out.append((h[at], key, at))
            yield _batch(out, _HIT)

    passed = keyed.mapInArrow(run, "h long, key binary, at int") if many else spark.createDataFrame([], "h long, key binary, at int")
    met = passed.join(F.broadcast(table) if many <= BROADCAST_HASHES else table, "h").select("key", "item_id", (F.col("at") - F.col("place")).alias("shift"))
    met = written(met.groupBy("key", "item_id").agg(F.collect_set("shift").alias("shifts")), "met")
    texts = keyed.join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    sizes = met.groupBy("key").agg(F.ceil(F.count("*") / ITEMS_A_ROW).cast("long").alias("slices"))
    known = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).distinct()
    grouped = met.join(sizes, "key").join(F.broadcast(known) if many <= BROADCAST_HASHES else known, "item_id").groupBy("key", F.pmod(F.xxhash64("item_id"), F.col("slices")).alias("slice"))
    rows = grouped.agg(F.collect_list(F.struct("item_id", "item", "shifts")).alias("met")).drop("slice").join(texts, "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Hashes()
        for part in parts(batches):
            keys, ids, shares = [], [], []
            for key, found, said in zip(part["key"].to_pylist(), part["met"].to_pylist(), part["text"].to_pylist()):
                values = tokens(said, store)
                for x in found:
                    item = tokens(x["item"], store)
                    best = max(agreement(values, item, s) for s in x["shifts"])
                    if best >= SHARE:
                        keys.append(key)
                        ids.append(x["item_id"])
                        shares.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(shares, pa.float64())], ["key", "item_id", "share"])

    scored = rows.select("key", "met", "text").mapInArrow(compare, "key binary, item_id long, share double")
    return scored.groupBy("key", "item_id").agg(F.max("share").alias("share"))


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_items, item_id, share, contaminated), one row per row of `docs`; item_id is the one that agrees best."""
    best = F.max(F.struct("share", (-F.col("item_id")).alias("minus"))).alias("best")
    found = hits(docs, items).groupBy("key").agg(F.count("*").alias("n_items"), best)
    out = docs.select("doc_id", _key().alias("key")).join(found, "key", "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("best.minus")).alias("item_id"), F.col("best.share").alias("share"), F.col("n_items").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` without a confirmed overlap, all columns."""
    dirty = hits(docs, items).select("key").distinct()
    return docs.select(F.struct("*").alias("row"), _key().alias("key")).join(dirty, "key", "left_anti").select("row.*")
