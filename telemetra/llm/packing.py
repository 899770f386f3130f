"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenised once and cut into pieces of at most `capacity` ids. The plan needs only how many pieces
have each length (at most `capacity` numbers): best-fit decreasing runs over those counts and yields runs of slots,
"ranks a to b of length l lie q to a sequence, from sequence s on, at offset o". A piece finds its slot by joining
on its length and its rank within that length, so no task ever needs all pieces of one length: ranks come from
counts per (length, task), summed over tasks.

Defined results: null text counts as empty; an empty text is the end id alone; only documents longer than
`capacity` are cut; repeated rows are separate documents; an empty table gives an empty result; `pack` carries
any other columns of its input, except that it replaces sequence_id and offset.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import bound_batches, parts, written

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps; on reaching it the store is emptied.
KEPT_WORDS = 400_000
#: Runs of slots up to this number are broadcast (48 bytes each), more are joined by shuffle.
BROADCAST_RUNS = 100_000


# How the word tokenizer cuts a word, and the letters (Latin, already composed, of one-letter lower case)
# for which this can be told without its normaliser.
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"(?!.*<\\|)[\\x21-\\x7e{_LETTER}]*", re.S)
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTER}]+|[0-9]|[^a-z{_LETTER}0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class _PartIds(dict):
    """Ids, as bytes, of the parts that the tokenizer cuts words into: characters 33 to 126 and the letters of _LETTER."""

    def __init__(self, tokenizer):
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        spelt = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
        if len(part) < 64:
            self[part] = ids
        return ids


class _WordIds(dict):
    """Little-endian uint32 ids of a word as bytes. Ids of a text are those of its words: the tokenizer never joins across white space.

    Plain words skip the normaliser and meet the vocabulary part by part, most of them from the store; others,
    and all words of a tokenizer with other rules, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.parts = tokenizer.encode, _PartIds(tokenizer)
        said = json.loads(tokenizer.to_str())
        cuts = [p.get("pattern", {}).get("Regex") for p in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        kinds = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        self.known = cuts == [_CUT, None] and kinds == ["NFC", "Replace", "Lowercase"]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if self.known and (word.isalpha() and word.isascii() or _PLAIN.fullmatch(word)):
            ids = b"".join([self.parts[x] for x in _PART.findall(word.lower())])
        else:
            ids = np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids


_WORKER: dict[str, _WordIds] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit numbers; every text ends with `end_id`."""
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _WORKER.setdefault(path, _WordIds(path))
        get = store.__getitem__
        for part in parts(batches):
            of, piece, start, length, out = [], [], [], [], []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                ids = b"".join(map(get, words)) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    out.append(ids[at : at + 4 * capacity])
                    of.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(out[-1]) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank_from, rank_to, sequence_from, offset, per_sequence)."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    room = np.zeros(capacity + 1, dtype=bool)
    out, fresh = [], 0

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            groups.setdefault(left, []).append((first, many))
            room[left] = True

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        n, rank = histogram[length], 0
        while n:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                left = length + int(fits[0])
                first, many = groups[left].pop()
                if not groups[left]:
                    room[left] = False
            else:
                left, first, many = capacity, fresh, -(-n // (capacity // length))
                fresh += many
            each = left // length
            whole = min(many, n // each)
            if whole:
                out.append((length, rank, rank + whole * each, first, capacity - left, each))
                rank, n = rank + whole * each, n - whole * each
                put(left - each * length, first, whole)
            first, many = first + whole, many - whole
            if n and many and n < each:  # fewer than a sequence takes
                out.append((length, rank, rank + n, first, capacity - left, each))
                put(left - n * length, first, 1)
                rank, n, first, many = rank + n, 0, first + 1, many - 1
            put(left, first, many)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with a `length` of 1 to `capacity`) with sequence_id and offset added.

    Ranks within a length are counted per task, then shifted by the counts of the tasks before; both the counts and the
    runs of slots are small tables (at most `capacity` rows a task, and a few runs a length), so a length that a third
    of all pieces have makes no hot task.
    """
    spark = pieces.sparkSession
    bound_batches(spark)
    pieces = written(pieces.drop("sequence_id", "offset"), "cut")  # not in one stage with the numbering: a second Python worker a task

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for part in parts(batches):
            lengths = part["length"].to_numpy(zero_copy_only=False)
            order = np.argsort(lengths, kind="stable")
            sorted_ = lengths[order]
            first = np.searchsorted(sorted_, sorted_)
            rank = np.empty(len(lengths), np.int64)
            rank[order] = seen[sorted_] + np.arange(len(sorted_)) - first
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([part["row"], part["length"], pa.array(np.full(len(lengths), task, np.int32)), pa.array(rank)], ["row", "length", "task", "rank"])

    rows = pieces.select(F.struct("*").alias("row"), F.col("length").cast("long").alias("length"))
    numbered = written(rows.mapInArrow(number, StructType([*rows.schema.fields, StructField("task", IntegerType()), StructField("rank", LongType())])), "pieces")
    counts = numbered.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    slots = spark.createDataFrame(runs or [(1, 0, 0, 0, 0, 1)], "length long, rank_from long, rank_to long, sequence_from long, run_offset long, per_sequence long")
    if len(runs) <= BROADCAST_RUNS:
        slots = F.broadcast(slots)
    before = counts.selectExpr("length", "task", "sum(n) over (partition by length order by task rows between unbounded preceding and current row) - n as before")
    ranked = numbered.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(slots, "length").where("rank >= rank_from and rank < rank_to")
    at = F.col("rank") - F.col("rank_from")
    return placed.select(
        "row.*",
        (F.col("sequence_from") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + at % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    pieces = tokenise(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)
