"""Near-duplicate documents by MinHash with tensored banding.

Two collections of `BANDS` short bands (`ROWS` minhashes each) are computed per document, and the key of table
(i, j) combines band i of the first with band j of the second: BANDS^2 tables from 2 * BANDS * ROWS minhashes
instead of BANDS^2 * 2 * ROWS. A pair of similarity s meets in some table with chance (1 - (1 - s^ROWS)^BANDS)^2,
0.9999 at 0.85 and 0.9994 at 0.8. Every link is confirmed on the full shingle sets.

Documents of equal word sequence form one class and only its representative is compared. In a table's bucket all
members are led by the most popular one, and in a few rounds each document is compared with one leader; only members
of buckets that still hold several components are then compared, those that share one of their rarest shingles and are
in different components, so documents near a leader cost their number, not its square, documents that only hold the
same passage meet no more, and no link between components that met in a bucket is lost.

Defined results: words split at ASCII white space, A-Z lower-cased; fewer words than the shingle length make one
shingle; null, empty and blank texts have none and link with nothing; texts of any length are taken whole; rows
that repeat an id are one node (linked through any of their texts); null ids get a null component and are kept;
other columns are ignored here and carried by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, parts, written

BANDS, ROWS = 8, 2
#: Rounds of comparison with leaders before the rest of each bucket is compared; any number gives the same result.
LEADER_ROUNDS = 3
#: Parts that the rows of one class of equal documents are dealt into.
SALTS = 32
#: Words whose hashes a task keeps; on reaching it the store is emptied.
KEPT_WORDS = 150_000
#: Cells of the table that tells rare shingles from frequent ones; it only orders them, so any number gives the same result.
CELLS = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, store: _Hashes) -> tuple[np.ndarray, list[bytes]]:
    """Distinct 64-bit shingle hashes of a text, and its words; a task's `store` keeps the hashes of words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64), words
    h = np.fromiter(map(store.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    acc = np.full(len(words) - n + 1, len(words) if len(words) < size else size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(acc), words


def _bands(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    low = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 8192):
        low = np.minimum(low, _mix(values[None, at : at + 8192] ^ seeds[:, None]).min(axis=1))
    return low


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, same, bands): `same` identifies the word sequence; bands is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Hashes()
        seeds = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for part in parts(batches):
            many, same, bands = [], [], []
            for text in part["text"].to_pylist():
                values, words = shingles(text, size, store)
                many.append(len(values))
                if not words:
                    same.append(None)
                    bands.append(None)
                    continue
                low = _bands(values, seeds).reshape(2 * BANDS, ROWS)
                acc = np.zeros(2 * BANDS, np.uint64)
                for k in range(ROWS):
                    acc = _mix(acc * np.uint64(31) + low[:, k])
                same.append(hashlib.md5(b" ".join(words)).hexdigest())
                bands.append(acc.view(np.int64))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(many, pa.int64()), pa.array(same, pa.string()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "same", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, same string, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Hashes()
        for part in parts(batches):
            sets = pa.array([shingles(t, size, store)[0].view(np.int64) for t in part["text"].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part["id"], sets], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The `pairs` (a, b) of document ids with 100 * intersection >= percent * union of the full shingle sets.

    A pair comes several times if an id does. Nothing is grouped behind the joins, so that skewed ones can be split.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_sets(docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi"), size), "sets")
    both = pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b").join(sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _needed(n: int, percent: int) -> int:
    """The least number of shingles that a set of `n` shares with any set of that similarity."""
    return -(-n * percent // 100)


def rare_pairs(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of other components that share one of the rarest shingles of each, from (id, component, text).

    In one common order of shingles, sets of similarity t share one of the first n - ceil(t * n) + 1 of each, and
    enough shingles follow the first that they share; so no link is lost, whatever the order. The order here
    is by how often a shingle's cell occurs in these texts, counted in a table of CELLS numbers.
    """
    spark = texts.sparkSession

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, store = np.zeros(CELLS, np.int64), _Hashes()
        for part in parts(batches):
            found = np.concatenate([shingles(text, size, store)[0] for text in part["text"].to_pylist()])
            total += np.bincount((found % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    counted = texts.select("text").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)  # CELLS numbers at any size of input
    often[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    often = spark.sparkContext.broadcast(often)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Hashes()
        for part in parts(batches):
            rows = [[np.empty(0, np.int64)] * 5]
            for i, component, text in zip(part["id"].to_pylist(), part["component"].to_pylist(), part["text"].to_pylist()):
                values = shingles(text, size, store)[0]
                n = len(values)
                if n:
                    values = values[np.lexsort((values, often.value[(values % np.uint64(CELLS)).astype(np.int64)]))][: n - _needed(n, percent) + 1]
                    k = len(values)
                    rows.append([values.view(np.int64), np.full(k, i), np.full(k, component), np.full(k, n), np.arange(k)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[c] for r in rows])) for c in range(5)], ["shingle", "id", "component", "n", "at"])

    rows = written(texts.mapInArrow(rarest, "shingle long, id long, component long, n long, at long"), "rare")
    held = rows.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("k"))
    mixed = written(rows.join(held.where("k > 1").drop("k"), "shingle"), "mixed")
    minor = mixed.where("component <> main").select("shingle", *[F.col(c).alias(c + "2") for c in ("id", "component", "n", "at")])
    both = mixed.join(minor, "shingle").where("component <> component2").where("component = main or id < id2")
    both = both.where(f"least(n, n2) * 100 >= {percent} * greatest(n, n2)").where(f"least(n - at, n2 - at2) * (100 + {percent}) >= {percent} * (n + n2)")
    return both.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of `docs`."""
    spark = docs.sparkSession
    sig = written(signatures(docs, size), "signatures")
    with_words = sig.where("same is not null and doc_id is not null")
    classes = written(with_words.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("many")), "classes")
    # rows of a large class meet its representative in SALTS tasks
    salted = with_words.select("doc_id", "same", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    reps = salted.select("same", "salt").distinct().join(classes.where("many > 1").select("same", "rep"), "same")
    copies = salted.join(reps, ["same", "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    keys = [F.xxhash64(F.lit(x), F.lit(y), F.col("bands")[x], F.col("bands")[BANDS + y]) for x in range(BANDS) for y in range(BANDS)]
    keyed = classes.select("rep", "n", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = written(keyed.join(shared, "key").distinct(), "members")
    popular = members.groupBy("rep").agg(F.sum("c").alias("popular"))
    close = f"least(n, n2) * 100 >= {percent} * greatest(n, n2)"
    leaders = members.join(popular, "rep").groupBy("key").agg(F.max(F.struct("popular", (-F.col("rep")).alias("minus"), "n")).alias("top"))
    leaders = leaders.select("key", (-F.col("top.minus")).alias("rep2"), F.col("top.n").alias("n2"), "top.popular")
    leaders = written(leaders, "leaders")
    led = written(members.join(leaders, "key").where("rep <> rep2").where(close).groupBy("rep", "rep2").agg(F.max("popular").alias("popular")), "led")
    links = tested = None
    comp = spark.createDataFrame([], "id long, component long")
    for _ in range(LEADER_ROUNDS):
        # each document with the most popular leader that it shares neither a known component nor an earlier comparison with
        open_ = led.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c1", F.coalesce("component", "rep")).drop("component")
        open_ = open_.join(comp.withColumnRenamed("id", "rep2"), "rep2", "left").where("c1 <> coalesce(component, rep2)")
        open_ = open_.withColumns({"a": F.greatest("rep", "rep2"), "b": F.least("rep", "rep2")})
        if tested is not None:
            open_ = open_.join(tested, ["a", "b"], "left_anti")
        pairs = written(open_.groupBy("rep").agg(F.max_by(F.struct("a", "b", "rep2"), F.struct("popular", "rep2")).alias("p")).select("rep", "p.*"), "pairs")
        found = written(verified(docs, pairs.select("a", "b").distinct(), size, percent), "links")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        # until all rounds are through, those linked with the same leader are known to be together, which leaves no pair out
        own = pairs.join(found.distinct(), ["a", "b"]).select(F.col("rep").alias("id"), F.col("rep2").alias("component"))
        comp = written(comp.unionByName(own).groupBy("id").agg(F.min("component").alias("component")), "together")
    comp = connected_components(links)
    placed = members.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = placed.join(split, "key", "left_semi").groupBy(F.col("rep").alias("id")).agg(F.first("component").alias("component"))
    texts = written(docs.select(F.col("doc_id").alias("id"), "text").join(open_, "id"), "texts")
    pairs = written(rare_pairs(texts, size, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(texts.withColumnRenamed("id", "doc_id"), pairs, size, percent), "links")

    known = comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
    comp = connected_components(known.unionByName(more).unionByName(copies))
    out = sig.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, all columns: of each component the row of the smallest id, one of rows equal in id and text."""
    gone = components(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rest = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    alone = rest.where("doc_id is null")
    known = rest.where("doc_id is not null").select("doc_id", F.md5("text").alias("same"), F.struct("*").alias("row"))
    known = known.groupBy("doc_id", "same").agg(F.first("row").alias("row")).select("row.*")
    return known.unionByName(alone)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, similarity 0.85."""
    return components(docs, 3, 85).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
