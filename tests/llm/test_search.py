"""Ranked search, clustering and languages against plain versions, odd rows and held-out rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest

from telemetra.llm import clusters, langid, search

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
ODD = [
    (1, "Alpha beta, beta GAMMA-delta"),
    (2, None),
    (3, ""),
    (4, " .,;!\x00\x7f"),
    (5, "alpha Ärger ärger ÄRGER x"),
    (6, "beta"),
    (6, "beta"),
    (None, "beta"),
    (7, "beta " * 3000 + "rare"),
    (8, "日本語 alpha beta 1st"),
    (9, "x" * 10_000),
]


def plain_search(docs, items, k=20):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    split = [(d, terms(t)) for d, t in docs]
    split = [(d, t) for d, t in split if t]
    n, total = len(split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for d, t in split:
            tf, m = Counter(t), 75 + 25 * len(t) * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in terms(text) if w in tf)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_odd(spark, monkeypatch, small):
    if small:
        for name, value in {"SHARD_DOCS": 2, "SHARD_TERMS": 5, "BLOCK_ITEMS": 2, "BLOCK_TERMS": 3, "SENT_TERMS": 4, "PIECE": 3, "MERGES": 2}.items():
            monkeypatch.setattr(search, name, value)
    items = [(1, "Alpha beta"), (1, "beta beta rare"), (2, None), (3, "..."), (4, "nowhere"), (None, "ärger Ärger"), (5, "gamma x 日本語 1ST")]
    rng = random.Random(4)
    more = [(100 + k, " ".join(rng.choice("alpha beta gamma x rare q w e".split()) for _ in range(rng.randrange(30)))) for k in range(90)]
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in ODD + more], "doc_id long, text string, score string, term int")
    got = search.digest(docs, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(ODD + more, items), key=key)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.digest(none, one).count() == 0
    assert search.digest(one.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_best_keeps_ties_in_order():
    rng = np.random.default_rng(1)
    for n in (1, 5, 20, 21, 500):
        scores = rng.integers(0, 4, n)
        want = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:20]
        assert search.best(scores, 20).tolist() == [i for _, i in want]


def plain_clusters(rows, k=8, rounds=10, seed=3, dim=64):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e):
            v = [floor(1024 * float(x)) for x in e]
            if max(map(abs, v)) <= clusters.LARGEST:
                kept.append((vec_id, v))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted((sha(f"{seed}:{i}"), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in kept] if centroids else []
    own = Counter()
    for _, d, n in last:
        own[n] += d
    return sorted(((i if i is not None else -1), n, d, own[n], sum(own.values()), sha(",".join(map(str, centroids[n])))) for i, d, n in last)


def check_clusters(spark, rows):
    vectors = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, cluster int, v string")
    got = clusters.digest(vectors)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rounded = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    assert sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in got.collect()) == plain_clusters(rounded)


def test_clusters_odd(spark):
    rng = np.random.default_rng(2)
    group = lambda n, at, wide: (at + wide * rng.standard_normal((n, 64))).tolist()
    rows = [(k, v) for k, v in enumerate(group(150, 0.0, 0.1) + group(80, 0.4, 0.02) + group(30, -90.0, 5.0))]
    same = [0.25] * 64
    rows += [(k, same) for k in range(300, 400)] + [(300, same), (300, [0.5] * 64), (None, same), (None, [1.0] * 64)]
    rows += [(401, None), (402, []), (403, [0.1] * 63), (404, [0.1] * 65), (405, [None] + [0.1] * 63), (406, [float("nan")] * 64), (407, [float("inf")] * 64), (408, [1e30] * 64), (409, [0.0] * 64)]
    check_clusters(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_clusters_of_few(spark, n):
    check_clusters(spark, [(k, [0.1 * k] * 64) for k in range(n)] + [(99, None)])


def test_screening_prunes_and_never_errs():
    rng = np.random.default_rng(3)
    for scale in (40, 1000, 1 << 26):
        v = rng.integers(-scale, scale, (400, 64))
        centroids = np.concatenate([v[:30], v[:2], v[40:60] + 1])
        rest = v - clusters.STEP * np.rint(v / clusters.STEP).astype(np.int64)
        cluster, distance, taken = clusters.nearest(v, clusters._norms(rest), (v * v).sum(axis=1), centroids)
        every = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert taken < every.size / 2 or scale == 40


LANGS = {"aa": "bal bel bil bol", "bb": "kran kren krin", "cc": "ши шо ша ше"}


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(LANGS[lang].split()) + rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(1, 40))), lang) for k in range(n) for lang in [rng.choice([*LANGS])]]


def test_languages(spark):
    odd = [(None, "balbel", "aa"), (1001, None, "aa"), (1002, "", "bb"), (1003, " 12 ²½ ...", "bb"), (1004, "balbal" * 9000, None), (1005, "krankrin " * 50_000, None), (1006, "шиша", None), (1006, "шиша", None)]
    rows = texts(300) + odd
    docs = spark.createDataFrame([(d, t, lang, "s", 1) for d, t, lang in rows], "doc_id long, text string, lang string, score string, h int")
    got = langid.digest(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[d].lang_pred for d in (1001, 1002, 1003, 1004, 1005, 1006)] == ["und"] * 3 + ["aa", "bb", "cc"]
    assert not by[1001].accepted and by[1001].score == 0
    held = [(by[d].lang_pred, lang) for d, _, lang in texts(300) if by[d].held_out]
    assert len(held) > 50 and all(a == b for a, b in held)


def test_languages_without_or_with_one(spark):
    none = spark.createDataFrame([(1, "bal", None), (2, "", "aa")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.digest(none).collect()] == ["und", "und"]
    assert langid.digest(none.where("doc_id > 5")).count() == 0
    one = spark.createDataFrame([(k, "bal bel", "aa") for k in range(9)] + [(10, "!", "aa")], "doc_id long, text string, lang string")
    assert Counter(r.lang_pred for r in langid.digest(one).collect()) == {"aa": 9, "und": 1}


def test_language_scores_need_no_lang_column_and_whole_words_count(spark):
    assert list(langid.words("Ab ab-c " * 2)) == [["ab", "ab", "c"] * 2]
    long = "x" * (langid.PIECE - 1) + " ab " + "y" * 50
    assert sum(piece.count("ab") for piece in langid.words(long)) == 1
    said = ["ab", "c", "abcdé", "ab"]
    rows, starts = langid.subwords(said)
    each = [rows[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(rows)])]
    assert each == [langid.subwords([w])[0].tolist() for w in said] and [len(x) for x in each] == [4 + 3 + 2 + 1 + 1, 3 + 2 + 1 + 1, 7 + 6 + 5 + 4 + 1, 11]
    docs = spark.createDataFrame(texts(200), "doc_id long, text string, lang string")
    model = langid.fit(docs)
    a = {r.doc_id: r.score for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    b = {r.doc_id: r.score for r in langid.predict(docs.withColumn("lang", docs.text), model).collect()}
    assert a == b


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = [r.lang_pred == r.lang for r in got]
    assert len(got) > 250 and np.mean(right) > 0.97
    taken = [r.lang_pred == r.lang for r in got if r.accepted]
    assert len(taken) > 0.7 * len(got) and np.mean(taken) > 0.98
