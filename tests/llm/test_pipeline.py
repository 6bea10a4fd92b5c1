import corpus_pipeline
from penmark.llm import mixing, ngram_join, ordinal, winnowing
from penmark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    model = ordinal.fit(docs, table(spark, SF, "labels"))
    kept = {r.doc_id for r in ordinal.score(docs, model).where("kept").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    docs = docs.where(docs.doc_id.isin(*kept))
    single = {r.doc_id for r in ngram_join.near_duplicates(docs, 5, 4, 5).collect() if r.doc_id == r.component_id}
    docs = docs.where(docs.doc_id.isin(*single))
    clean = {r.doc_id for r in winnowing.contamination(docs, table(spark, SF, "benchmark")).collect() if not r.contaminated}
    docs = docs.where(docs.doc_id.isin(*clean))
    mixed = sorted(r.doc_id for r in mixing.mix(docs).collect())
    assert 0 < len(mixed) and sorted(r.doc_id for r in got) == mixed and set(mixed) <= kept & single & clean
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
