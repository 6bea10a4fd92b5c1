import hashlib
import itertools

from penmark.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string, window int, start int"
SF = "/root/testdata/sf0.001"


def brute(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0] is not None, r[0], r[1] is not None, *r[1:]))
    out = []
    for conv, turns in itertools.groupby(rows, key=lambda r: r[0]):
        turns = list(turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha(said), "loss_chars": len(loss), "loss_sha256": sha(loss)})
    return out


def odd(spark):
    marks = ["</s>[INST] ok [/INST]", "\\<s>\\\\[INST", "<\\s>", "", None, "\n [/INST]é😀", "a\\"]
    data = [(1, i, ["system", "user", "assistant", None, "to]ol</s>"][i % 5] if i else "system", f"{marks[i % 7] or ''}{'word ' * (i % 40)}" if i % 9 else marks[i % 7]) for i in range(300)]
    data += [(2, None, "assistant", "x"), (2, None, "assistant", "x"), (2, 5, "assistant", "long " * 3000), (2, 6, "user", "q"), (2, 7, "assistant", "a")]
    data += [(None, 1, "user", "null id"), (3, 1, "system", "s"), (3, 2, "assistant", "")]
    return data, spark.createDataFrame([(*r, 0, 0) for r in data], SCHEMA)


def test_round_trip(spark, same):
    data, df = odd(spark)
    for budget, history in ((1024, 256), (60, 20), (30, 0)):
        windows = chat_format.chat_windows(df, budget, history)
        same(chat_format.digest(windows).drop("formatted_chars"), brute(data))


def test_windows_keep_to_the_budget(spark):
    _, df = odd(spark)
    rows = chat_format.chat_windows(df.where("conv_id = 1"), 200, 60).collect()
    system = next(r.text for r in rows if r.window == 0).split("</s>")[0]
    assert len(rows) > 5
    for r in rows:
        turns = r.text[3:].split("</s>")[:-1]
        assert r.text.startswith(system) and 0 <= r.n_context < len(turns)
        assert all(r.text[s.start - len("[/INST]") : s.start] == "[/INST]" and r.text[s.end : s.end + 4] == "</s>" for s in r.loss)
    assert any(r.n_context > 1 for r in rows)


def test_query_and_empty(spark, same):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op8_chat_windows(spark, SF)
    same(got.drop("formatted_chars"), brute([*map(tuple, rows), *probe]))
    assert chat_format.digest(chat_format.chat_windows(spark.createDataFrame([], SCHEMA))).count() == 0
