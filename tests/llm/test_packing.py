import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from penmark.llm import packing
from penmark.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, n long, rank int, ids string"


def verify(pieces, docs, window=packing.WINDOW):
    """Every id of every document once, no gaps, no padding."""
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(k), (tokenizer.encode(x or "", add_special_tokens=False).ids if x else []) + [0]) for k, x in docs)
    rows = pieces.collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    if len({k for k, _ in docs}) == len(docs):
        got = []
        for k, some in by_doc.items():
            some.sort(key=lambda r: r.start)
            assert [r.start for r in some] == np.cumsum([0, *(r.length for r in some)])[:-1].tolist()
            got.append((str(k), np.frombuffer(b"".join(r.ids for r in some), "<u4").tolist()))
        assert sorted(got) == want
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    return rows


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pieces = packing.pack(docs, PATH)
    rows = verify(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(pieces).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}
    whole = packing.sequences(pieces).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)


def test_small_windows_and_odd_rows(spark):
    texts = [None, "", "a", "a b", "a b c", "x " * 5000, "word"] + ["one two"] * 40 + ["one two three four five"] * 25 + [None] * 30
    docs = spark.createDataFrame([(i, x, "p", 1, 2, "i") for i, x in enumerate(texts)], SCHEMA).repartition(5)
    verify(packing.pack(docs, PATH, window=16), list(enumerate(texts)), 16)
    # null and repeated ids are documents of their own
    same = spark.createDataFrame([(None if i % 2 else 7, "some words here", "p", 1, 2, "i") for i in range(20)], SCHEMA)
    assert len({(r.sequence_id, r.offset) for r in verify(packing.pack(same, PATH, window=16), [(None if i % 2 else 7, "some words here") for i in range(20)], 16)}) >= 20
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_counts_never_exceed_the_histogram():
    rng = np.random.default_rng(5)
    for window, top in ((16, 50), (64, 3), (64, 1000)):
        histogram = rng.integers(0, top, window)
        combos, taken = packing.solve(histogram, window)
        used = np.bincount(combos.ravel(), np.repeat(taken, 3), window + 1)[:window]
        used[0] = 0
        assert (combos.sum(1) == window).all() and (taken > 0).all() and (used <= histogram).all()
    assert len(packing.solve(np.zeros(16, np.int64), 16)[1]) == 0


def test_least_squares_finds_an_exact_solution():
    combos = packing.combinations(np.arange(1, 16), 16)
    x = np.zeros(len(combos))
    x[[1, 5, 9]] = 100, 70, 30
    histogram = np.bincount(combos.ravel(), np.repeat(x, 3), 17)
    histogram[0] = 0
    got = packing.least_squares(combos, histogram, 3000)
    back = np.bincount(combos.ravel(), np.repeat(got, 3), 17)[1:]
    assert np.abs(back - histogram[1:]).max() < 0.5
