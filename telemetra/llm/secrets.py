"""Secrets by pattern and by character Markov models.

Fixed patterns give base spans. Beyond them, a token of 16 or more key characters is a secret if a Markov model of
random strings explains it better, per character, than one of ordinary identifiers. Both models are counts of
character pairs over the whole corpus, so no list of words and no capped sample is needed. The labelled samples of
random strings are the values of base spans of kinds assign and access; those of ordinary identifiers are all tokens
of eight or more key characters that hold no base value and are too short for a key or without digits. Each model is
mixed with the uniform one, the first by half, because labelled values of one alphabet (say hexadecimal) must not
make those of another unlikely. Only DataFrame functions are used.

Defined results: null and empty texts have no spans; offsets are code points, ends are exclusive; spans of one
kind never overlap, and spans of the method never overlap a base span; whole texts are read; repeated rows get
equal results; other columns are ignored; with no labelled value the method adds nothing.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The patterns of the contract. The last two find the runs that pass its length limits directly.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY_LIKE = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z0-9+/_.=-]{8,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Shares of the uniform model in that of random strings and in that of identifiers.
MIX_RANDOM, MIX_PLAIN = 0.5, 0.01
#: Pairs that the single characters' model counts for in that of pairs.
BACK_OFF = 5.0
#: Least log-likelihood ratio per character pair, in nats. See the README for how planted keys and corpus words lie around it.
MARGIN = 1.0


#: Steps that one fold adds up at least.
BLOCK = 64


def _starts(steps: Column) -> Column:
    """Where each match starts, from (g, n): the characters before it since the last match, and its own.

    A fold copies its array at each step, so it goes over blocks of the root of their number, and over the blocks' sums.
    """
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(steps))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / size).cast("int")), lambda k: F.slice(steps, k * size + 1, size))
    sums = F.transform(blocks, lambda b: F.struct(F.lit(0).alias("g"), F.aggregate(b, F.lit(0), lambda s, x: s + x["g"] + x["n"]).alias("n")))
    return F.when(F.size(steps) > 0, F.flatten(F.zip_with(blocks, _folded(sums, F.lit(0)), _folded)))


def _folded(steps: Column, begin: Column) -> Column:
    state = F.struct(F.array().cast("array<int>").alias("starts"), begin.alias("at"))
    add = lambda s, x: F.struct(F.concat(s["starts"], F.array(s["at"] + x["g"])).alias("starts"), (s["at"] + x["g"] + x["n"]).alias("at"))
    return F.aggregate(steps, state, add)["starts"]


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches of `pattern`."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(values)), F.transform(values, F.length), lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    folded = F.transform(F.array(steps), _starts)[0]  # a variable, so that no block finds the matches anew
    made = F.zip_with(folded, values, lambda a, v: F.struct(a.alias("start"), (a + F.length(v)).alias("end"), v.alias("value")))
    return F.when(F.size(values) > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _pairs(tokens: DataFrame) -> DataFrame:
    """(pair, n): counts of character pairs over a column `value`; equal values are counted before their pairs."""
    two = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    values = tokens.where(F.length("value") > 1).groupBy("value").agg(F.count("*").alias("c"))
    return values.select("c", F.explode(two).alias("pair")).groupBy("pair").agg(F.sum("c").alias("n"))


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, text, assign, access, hex): arrays of spans."""
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(spans(text, ASSIGN), lambda m: F.length(F.regexp_replace(m["value"], ASSIGN_HEAD, "")) >= 12)
    return docs.select("doc_id", text.alias("text"), assign.alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"))


def weights(found: DataFrame) -> list[float] | None:
    """Log ratio of the two models for each pair of ALPHABET, row by row; None without labelled values."""
    keys = F.transform("assign", lambda m: F.regexp_replace(m["value"], ASSIGN_HEAD, ""))
    random = found.select(F.explode(F.concat(keys, F.transform("access", lambda m: m["value"]))).alias("value"))
    labelled = F.concat(keys, F.transform(F.concat("access", "hex"), lambda m: m["value"]))
    tokens = F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))
    plain = found.select(F.explode(F.filter(tokens, lambda t: ((F.length(t) < 16) | ~t.rlike("[0-9]")) & ~F.exists(labelled, lambda v: F.contains(t, v)))).alias("value"))
    counts = _pairs(random).withColumn("kind", F.lit(1)).unionByName(_pairs(plain).withColumn("kind", F.lit(0)))
    size = len(ALPHABET)
    seen = [[[0] * size for _ in range(size)] for _ in range(2)]
    place = {c: k for k, c in enumerate(ALPHABET)}
    for r in counts.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=.-]{2}$")).collect():  # at most two rows for each pair of ALPHABET
        seen[r.kind][place[r.pair[0]]][place[r.pair[1]]] += r.n
    if not any(map(sum, seen[1])):
        return None

    alone = [[sum(row[b] for row in m) / max(sum(map(sum, m)), 1) for b in range(size)] for m in seen]

    def chance(kind: int, a: int, b: int) -> float:
        """Of b after a: pairs, with single characters where pairs are few, mixed with the uniform model."""
        mix = (MIX_PLAIN, MIX_RANDOM)[kind]
        return mix / size + (1 - mix) * (seen[kind][a][b] + BACK_OFF * alone[kind][b]) / (sum(seen[kind][a]) + BACK_OFF)

    return [math.log(chance(1, a, b) / chance(0, a, b)) for a in range(size) for b in range(size)]


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = written(base(docs), "base")
    table = weights(found)
    model = F.array().cast("array<struct<start:int,end:int,value:string>>")
    if table is not None:
        ratio = F.from_json(F.lit(json.dumps([round(x, 5) for x in table])), "array<double>")
        code = lambda v: F.transform(F.split(v, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)

        def llr(v: Column) -> Column:
            codes = code(v)
            pairs = F.zip_with(F.slice(codes, 1, F.length(v) - 1), F.slice(codes, 2, F.length(v) - 1), lambda a, b: F.get(ratio, a * len(ALPHABET) + b))
            return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (F.length(v) - 1)

        taken = F.concat("assign", "access", "hex")
        free = lambda m: ~F.exists(taken, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"]))
        model = F.filter(spans(F.col("text"), KEY_LIKE), lambda m: free(m) & (llr(m["value"]) >= MARGIN))
    told = lambda kind, order, column: F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), F.concat_ws(":", F.lit(kind), m["start"], m["end"]).alias("said")))
    joined = lambda *parts: F.concat_ws(",", F.transform(F.array_sort(F.concat(*parts)), lambda m: m["said"]))
    kinds = [told("assign", 0, F.col("assign")), told("access", 1, F.col("access")), told("hex", 2, F.col("hex"))]
    return found.withColumn("model", model).select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(joined(*kinds).cast("binary"), 256).alias("base_sha256"),
        joined(*kinds, told("model", 3, F.col("model"))).alias("spans"),
    )
