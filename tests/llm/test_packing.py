import struct
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from telemetra.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_fills_without_gap_or_overlap(histogram):
    used = defaultdict(list)
    for length, a, b, first, offset, each in packing.plan(histogram, 40):
        for k in range(b - a):
            used[first + k // each].append((offset + k % each * length, length))
    assert sum(len(v) for v in used.values()) == sum(histogram.values())
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 40
    # as best-fit decreasing over single items gives
    bins = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= length]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= length
        else:
            bins.append(40 - length)
    assert len(used) == len(bins)


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Hello, World's end."), (2, None), (3, ""), (4, "ab " * 3000), (5, "tab\tand\nline\r\nnew  two"), (5, "tab\tand\nline\r\nnew  two"), (6, "Été İ ΣΣ \x1c x")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, length string")
    got = packing.digest(docs).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc_id, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)


def test_empty_table(spark):
    assert packing.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
