"""Headline timings. Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each step is forced with a ``noop`` write (full execution, nothing
collected) or is a job by itself (the fit).
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from penmark.functions.metrics import with_text_metrics  # noqa: E402
from penmark.operators import kmeans, scoring  # noqa: E402
from penmark.plans import pipeline  # noqa: E402
from penmark.plans.marked import marked_documents  # noqa: E402
from penmark.session import ensure_checkpoint_dir, local_session  # noqa: E402
from penmark.sources.corpus import table  # noqa: E402
from penmark.streaming.score_stream import start_scoring  # noqa: E402


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, cpus))
    ckpt = ensure_checkpoint_dir(spark)
    spread = 2 * cpus  # each test table is one row group, read by one task
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    docs = table(spark, sf, "documents", "doc_id", "text")
    n_docs = docs.count()
    # warm the JVM, the emoji table and the regex code paths on another table
    _noop(with_text_metrics(table(spark, sf, "conversations", "conv_id", "text"), "text"))

    t = time.time()
    _noop(with_text_metrics(docs, "text", rebalance=spread))
    times["text_metrics"] = time.time() - t
    extra["text_metrics_texts_per_sec"] = n_docs / times["text_metrics"]

    t = time.time()
    pages = table(spark, sf, "pages", "page_id", "html")
    _noop(with_text_metrics(pages, "html", rebalance=spread))
    times["text_metrics_pages"] = time.time() - t

    corpus = marked_documents(spark, sf, ("doc_id", "text"))
    t = time.time()
    res = pipeline.train(corpus.repartition(spread), ["doc_id"])
    times["fit"] = time.time() - t
    extra["fit_rounds_best_run"] = res.model.n_iter
    extra["fit_rounds_total"] = sum(r["n_iter"] for r in res.fit.runs)
    extra["distinct_points"] = res.points.count()

    t = time.time()
    kmeans.lloyd_step(res.points, {r: res.model.centroids for r in range(10)})
    times["lloyd_round_10_runs"] = time.time() - t

    t = time.time()
    _noop(scoring.score(docs.repartition(spread), res.model, keep=["doc_id"]))
    times["score"] = time.time() - t
    extra["score_texts_per_sec"] = n_docs / times["score"]

    src = os.path.join(ckpt, f"bench-stream-src-{uuid.uuid4().hex}")
    docs.repartition(8).write.parquet(src)
    sink = os.path.join(ckpt, f"bench-stream-sink-{uuid.uuid4().hex}")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    t = time.time()
    q = start_scoring(stream, res.model, sink, keep=["doc_id"])
    q.awaitTermination()
    times["score_stream"] = time.time() - t
    extra["score_stream_texts_per_sec"] = n_docs / times["score_stream"]
    extra["score_stream_rows"] = spark.read.parquet(sink).count()

    total = sum(times.values())
    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "extra": {k: round(v, 3) for k, v in extra.items()},
                "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                "docs": n_docs,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
