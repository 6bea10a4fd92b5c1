"""Command line: ``python -m penmark {train,score,metrics} ...`` (or via
``spark-submit``). Uses the session the environment configures; on a
cluster set ``spark.checkpoint.dir`` to a shared folder.

  train   <texts.parquet> <model_dir> [--text COL] [--key COL] [--report DATE] [--runs N] [--settings FILE.json]
  score   <texts.parquet> <model_dir> <out_dir> [--text COL] [--key COL] [--by-cluster]
  metrics <texts.parquet> <out_dir> [--text COL] [--key COL]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions.metrics import with_text_metrics
from .operators.scoring import score
from .plans.pipeline import train, training_report, write_scores
from .session import ensure_checkpoint_dir
from .sources.model_io import load_model, save_model


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="penmark", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("train", "score", "metrics"):
        p = sub.add_parser(name)
        p.add_argument("texts")
        if name in ("train", "score"):
            p.add_argument("model")
        if name in ("score", "metrics"):
            p.add_argument("out")
        p.add_argument("--text", default="text")
        p.add_argument("--key", default="doc_id")
        if name == "train":
            p.add_argument("--report", default=None, help="date for the report line (default: today)")
            p.add_argument("--runs", type=int, default=None)
            p.add_argument("--settings", default=None, help='JSON file: {"weights": {metric: x}, "lexicons": {family: [phrase]}}')
        if name == "score":
            p.add_argument("--by-cluster", action="store_true", help="one folder per verdict")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"penmark-{args.cmd}").getOrCreate()
    ensure_checkpoint_dir(spark)
    texts = spark.read.parquet(args.texts)

    if args.cmd == "train":
        extra = {"runs": args.runs} if args.runs else {}
        if args.settings:
            with open(args.settings, encoding="utf-8") as f:
                given = json.load(f)
            extra |= {name: given.get(name) for name in ("weights", "lexicons")}
        res = train(texts.select(args.key, args.text), [args.key], args.text, **extra)
        save_model(res.model, spark, args.model)
        row = training_report(res, args.report).collect()[0]
        print(f"ai_cluster={res.model.ai_cluster} human=({row['human_pct']}%, {row['human']}) "
              f"ai=({row['ai_pct']}%, {row['ai']}) date={row['date']} inertia={res.model.inertia:.6f} "
              f"rounds={res.model.n_iter} converged={res.model.converged}")
    elif args.cmd == "score":
        model = load_model(spark, args.model)
        write_scores(score(texts, model, text=args.text, keep=[args.key]), args.out, by_cluster=args.by_cluster)
    else:
        with_text_metrics(texts.select(args.key, args.text), args.text).write.parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
