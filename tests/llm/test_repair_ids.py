import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from penmark.llm import queries, repair_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a  b", " a b", "a\n b\tc ", "é😀 x  y", "it's  <|endoftext|> 12 34", "the same the same " * 5000, "x\r\n\r\n y", "  z z"]


def brute(rows):
    t, start, out = TOKENIZER, 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append({"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
        start += len(ids)
    return out


def test_query(spark, same):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    same(queries.op9_token_shards(spark, SF), brute(map(tuple, rows)))


def test_odd_texts_and_small_shards(spark, same, monkeypatch):
    df = spark.createDataFrame([(i, x, 0, "f") for i, x in enumerate(TEXTS)], "doc_id long, text string, start int, file string")
    same(repair_ids.read_documents(repair_ids.write_shards(df, PATH)), brute(enumerate(TEXTS)))
    assert repair_ids.read_documents(repair_ids.write_shards(df.limit(0), PATH)).count() == 0
    twins = spark.createDataFrame([(None, "n"), (5, "same"), (5, "same")], "doc_id long, text string")
    same(repair_ids.read_documents(repair_ids.write_shards(twins, PATH)), brute([(None, "n"), (5, "same"), (5, "same")]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet="abThªéłß '\n\t\r é1.,!<|endoftext|> ", max_size=30), max_size=4))
def test_pieces_give_the_same_ids(texts):
    expected = [TOKENIZER.encode(x, add_special_tokens=False).ids for x in texts]
    ids, sizes = repair_ids.encode(PATH, pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == expected


def test_shards_are_cut_inside_a_batch(spark, same, monkeypatch):
    rows = [(i, "word " * (i % 90)) for i in range(300)] + [(300, "long " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(repair_ids, "SHARD_TOKENS", 500)
    shards = repair_ids.write_shards(df, PATH)
    sizes = [(r.n_ids, r.n_docs) for r in shards.collect()]
    assert len(sizes) > 20 and all(n <= 500 or docs == 1 for n, docs in sizes)
    same(repair_ids.read_documents(shards), brute(rows))


def test_attempts_write_the_same_bytes_under_their_own_names(spark, monkeypatch):
    rows = [(5, "b"), (5, "a"), (None, "c"), (None, None), (5, "a"), (None, "a")]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        files = [r.file for r in repair_ids.write_shards(df, PATH).orderBy("part", "seq").collect()]
        places = [repair_ids.open_fs(f) for f in files]
        got.append((files, [fs.open_input_file(path).read() for fs, path in places]))
    assert got[0][1] == got[1][1] and not {f.rsplit("/")[-1] for f in got[0][0]} & {f.rsplit("/")[-1] for f in got[1][0]}


def test_grammar_and_random_access():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 40, 30_000), np.zeros(5_000, int), np.tile([7, 8, 9, 9, 9], 4_000), [50256]])
    ends = np.unique(np.r_[rng.integers(1, len(ids), 200), len(ids)])
    data = repair_ids.pack(ids.astype(np.uint16), ends, 50257)
    shard = repair_ids.Shard(data)
    assert len(shard.rules) > 100 and len(data) < len(ids)
    assert (repair_ids.expand(shard.symbols, shard.rules, 50257) == ids).all()
    starts = np.r_[0, ends[:-1]]
    for k in (0, 1, 57, len(ends) - 1):
        assert (shard.document(k) == ids[starts[k] : ends[k]]).all()
    for at, n in ((0, 1), (1, 5000), (len(ids) - 1, 1), (31_000, 77), (12_345, 0)):
        assert (shard.read_ids(at, n) == ids[at : at + n]).all()


def test_rules_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    ids = np.tile(rng.integers(0, 50_000, 1_000), 64).astype(np.uint16)
    ends = np.arange(4_000, len(ids) + 1, 4_000)
    rules, symbols, firsts = repair_ids.compress(ids, ends, 50257)
    last = np.zeros(len(symbols), bool)
    last[firsts[1:].astype(int) - 1] = True
    pairs = np.stack([symbols[:-1], symbols[1:]], 1)[~last[:-1]]
    assert len(rules) < repair_ids.SYMBOLS - 50257 and np.unique(pairs, axis=0, return_counts=True)[1].max(initial=0) < repair_ids.MIN_PAIRS
    shard = repair_ids.Shard(repair_ids.pack(ids, ends, 50257))
    assert (repair_ids.expand(shard.symbols, shard.rules, 50257) == ids).all() and len(symbols) <= 64
    for k in (0, 7, len(ends) - 1):
        assert (shard.document(k) == ids[4_000 * k : 4_000 * (k + 1)]).all()
    for at, n in ((0, 1), (3_999, 2), (31_234, 5_000), (len(ids) - 1, 1)):
        assert (shard.read_ids(at, n) == ids[at : at + n]).all()
