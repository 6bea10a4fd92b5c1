"""penmark: Spark-native text stylometry (style metrics, L∞ k-means, scoring).

Main entry points::

    from penmark import with_text_metrics, fit_pipeline, score, score_stream
"""

from .functions.metrics import with_text_metrics
from .operators.kmeans import compact, fit_points, predict
from .operators.report import cluster_counts, corpus_report, report_by, sample_per_cluster
from .operators.scoring import metrics_summary, nonzero_metrics, predict_text, score
from .plans.pipeline import cluster_samples, fit_pipeline, train, write_scores
from .sources.model_io import Model, load_model, save_model
from .streaming.score_stream import score_stream, start_scoring

__all__ = [
    "Model", "cluster_counts", "cluster_samples", "compact", "corpus_report", "fit_pipeline", "fit_points",
    "load_model", "metrics_summary", "nonzero_metrics", "predict", "predict_text", "report_by",
    "sample_per_cluster", "save_model", "score", "score_stream", "start_scoring", "train",
    "with_text_metrics", "write_scores",
]
__version__ = "0.1.0"
