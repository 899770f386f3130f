"""Removal of repeated runs of lines, by suffix ranks over line ids.

A document is a sequence of line ids (a line's MD5; a position is document and line number). Lines that occur
once can't be part of a repeat and are left out. Prefix doubling then ranks the runs of 1, 2, 4 ... lines that
start at each position: the rank of 2k lines is the place of (rank here, rank k lines on) among the sorted
distinct pairs, and positions whose run occurs once drop out, so rounds end with the longest repeat. The suffixes of
one longest-common-prefix interval of depth L are those whose ranks for the greatest power of two within L agree both
at the start and at the end of their first L lines, so an interval is a group by two ranks, at any depth. A repeated run that has `min_words`
words is the union of the shortest windows in it with that many words, seen from each of its lines forwards and
backwards; every such window whose interval holds an earlier position is a later copy, and its lines go.

Only DataFrame functions are used; ranks are numbered by sorted partition, not in one task.

Defined results: lines split at newline and are compared exactly; order is by doc_id (nulls last), then line; null
text stays null and has no lines, empty text is one empty line; rows equal in doc_id and text count as one
document and get the same result; texts without such repeats come back unchanged; an empty table is empty; of
copies that overlap in one document the first window stays except for lines that are in a later one; other
columns are carried, whatever their names, but n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_WORDS = 50
_LAST = (1 << 63) - 1


def _numbered(pairs: DataFrame) -> DataFrame:
    """`pairs` with `rank`: its place in the order of (r1, r2)."""
    low = (1 << 33) - 1
    placed = written(pairs.orderBy("r1", "r2").withColumn("mono", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("mono", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return placed.join(F.broadcast(before), part == F.col("part")).select("r1", "r2", (F.col("mono").bitwiseAND(low) + F.col("before")).alias("rank"))


def _key() -> Column:
    """Identifies a document by id and text."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))


def ranks(lines: DataFrame) -> list[DataFrame]:
    """From (key, line, r1) the tables (key, line, rank) of repeated runs of 1, 2, 4 ... lines."""
    repeated = lines.groupBy("r1").agg(F.count("*").alias("c")).where("c > 1").select("r1", F.lit(0).cast("long").alias("r2"))
    levels = [written(lines.join(_numbered(repeated), "r1").select("key", "line", "rank"), "level")]
    while True:
        now, step = levels[-1], 1 << (len(levels) - 1)
        ahead = now.select("key", (F.col("line") - step).alias("line"), F.col("rank").alias("r2"))
        both = written(now.withColumnRenamed("rank", "r1").join(ahead, ["key", "line"]), "doubled")
        pairs = both.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        nxt = written(both.join(_numbered(pairs), ["r1", "r2"]).select("key", "line", "rank"), "level")
        if nxt.isEmpty():
            return levels
        levels.append(nxt)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, line): the lines that belong to later copies; key as `_key` gives it."""
    keyed = docs.where("text is not null").select(_key().alias("key"), F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), "text").dropDuplicates(["key"])
    split = keyed.select("key", "ord", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = F.size(F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = written(split.select("key", "ord", "line", F.unhex(F.md5("t")).alias("r1"), words.cast("long").alias("words")), "lines")
    levels = ranks(lines.select("key", "line", "r1"))

    # islands of neighbouring repeated lines, with running word counts
    w = Window.partitionBy("key").orderBy("line")
    base = levels[0].select("key", "line").join(lines.drop("r1"), ["key", "line"])
    base = base.withColumn("island", F.col("line") - F.row_number().over(w)).withColumn("upto", F.sum("words").over(Window.partitionBy("key", "island").orderBy("line")))
    # a window ends at the first line with enough words after its start, and starts at the last one before its end
    ahead = F.min("line").over(Window.partitionBy("key", "island").orderBy("upto").rangeBetween(min_words, Window.unboundedFollowing))
    back = F.max("line").over(Window.partitionBy("key", "island").orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    first = F.min("line").over(Window.partitionBy("key", "island"))
    marks = base.withColumns({"ahead": ahead, "back": back, "first": first})
    # ahead: first line whose running count is min_words past that of `line`: the window starts one line on
    island_ends = F.col("upto") >= min_words
    fwd = marks.where("ahead is not null").select("key", "ord", (F.col("line") + 1).alias("s"), F.col("ahead").alias("e"))
    lead = marks.where(island_ends).groupBy("key", "ord", "island").agg(F.min("first").alias("s"), F.min("line").alias("e")).drop("island")
    bwd = marks.where(island_ends).select("key", "ord", F.coalesce(F.col("back") + 1, "first").alias("s"), F.col("line").alias("e"))
    windows = fwd.unionByName(lead).unionByName(bwd).distinct()
    windows = windows.withColumn("n", F.col("e") - F.col("s") + 1).withColumn("k", F.floor(F.log2(F.col("n") + F.lit(0.25))).cast("int"))
    windows = written(windows, "windows")

    # all levels in one table, so that two joins give every window both of its ranks
    stacked = None
    for k, level in enumerate(levels):
        one = level.select("key", "line", F.lit(k).alias("k"), "rank")
        stacked = one if stacked is None else stacked.unionByName(one)
    tagged = windows.withColumn("s2", F.col("e") + 1 - F.expr("shiftleft(1, k)"))
    tagged = tagged.join(stacked.withColumnsRenamed({"line": "s", "rank": "ra"}), ["key", "s", "k"])
    tagged = tagged.join(stacked.withColumnsRenamed({"line": "s2", "rank": "rb"}), ["key", "s2", "k"])
    tagged = written(tagged.select("key", "ord", "s", "e", "n", "ra", "rb"), "tagged")
    place = F.struct("ord", "key", "s")
    # written, so that the join behind it can be split where an interval holds very many suffixes
    earliest = written(tagged.groupBy("n", "ra", "rb").agg(F.min(place).alias("at"), F.count("*").alias("c")).where("c > 1").drop("c"), "earliest")
    later = tagged.join(earliest, ["n", "ra", "rb"]).where(place > F.col("at"))
    return later.select("key", F.explode(F.sequence("s", "e")).alias("line")).distinct()


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with text reduced to the lines that stay, and n_lines and n_removed added."""
    gone = repeats(docs, min_words).groupBy("key").agg(F.collect_set("line").alias("gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", _key().alias("key")).join(gone, "key", "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda t, i: ~F.array_contains("gone", i))
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    return out.select(
        *[new.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
