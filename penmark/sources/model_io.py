"""The model table: k centroids, which one is the AI cluster, and the weights
and phrase lists that the features were made with, together.

Stored as one small Parquet table ``(cluster INT, centroid ARRAY<DOUBLE>,
is_ai BOOLEAN, inertia DOUBLE, n_iter INT, converged BOOLEAN, run INT,
version INT, weights ARRAY<DOUBLE>, lexicons MAP<STRING, ARRAY<STRING>>,
lexicon_digest STRING)``, so these facts can never go out of step. Every row
has the weights and the digest of all phrase families in force; the lists
that replace built-in ones are in the row of cluster 0 only. Loading reads and
validates the k rows once; scoring then embeds the centroids as literals.

A table of version 1 has neither the last four columns nor weights or lists
of its own: it is read with the fixed ones. A newer version is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon
from ..functions.features import resolve_weights

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("cluster", T.IntegerType(), False),
        T.StructField("centroid", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("is_ai", T.BooleanType(), False),
        T.StructField("inertia", T.DoubleType(), True),
        T.StructField("n_iter", T.IntegerType(), True),
        T.StructField("converged", T.BooleanType(), True),
        T.StructField("run", T.IntegerType(), True),
        T.StructField("version", T.IntegerType(), True),
        T.StructField("weights", T.ArrayType(T.DoubleType(), False), True),
        T.StructField("lexicons", T.MapType(T.StringType(), T.ArrayType(T.StringType(), False), False), True),
        T.StructField("lexicon_digest", T.StringType(), True),
    ]
)

VERSION = 2

MAX_CLUSTERS = 4096  # a model is small by construction; refuse anything else


@dataclass
class Model:
    centroids: list[list[float]]
    ai_cluster: int
    inertia: float | None = None
    n_iter: int | None = None
    converged: bool | None = None
    run: int | None = None
    weights: list[float] | None = None  # None: the fixed ones
    lexicons: dict[str, list[str]] | None = None  # families that replace built-in ones
    lexicon_digest: str | None = None  # of all families in force when it was trained

    def check_lexicons(self) -> None:
        """The phrase lists that scoring would use must be those of training."""
        if self.lexicon_digest is not None and self.lexicon_digest != lexicon.digest(self.lexicons):
            raise ValueError("the model was trained with other phrase lists than those at hand")

    def validate(self, dim: int = lexicon.N_FEATURES) -> "Model":
        k = len(self.centroids)
        if k < 1 or k > MAX_CLUSTERS:
            raise ValueError(f"model has {k} centroids")
        if any(len(c) != dim for c in self.centroids):
            raise ValueError(f"every centroid must have {dim} values")
        if not 0 <= self.ai_cluster < k:
            raise ValueError("the AI cluster is not one of the centroids")
        resolve_weights(self.weights)
        unknown = set(self.lexicons or {}) - set(lexicon.FAMILIES)
        if unknown:
            raise ValueError(f"unknown phrase families: {sorted(unknown)}")
        return self

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, [float(v) for v in c], i == self.ai_cluster, self.inertia, self.n_iter, self.converged, self.run, VERSION,
             resolve_weights(self.weights), (self.lexicons or None) if i == 0 else None,
             self.lexicon_digest or lexicon.digest(self.lexicons))
            for i, c in enumerate(self.centroids)
        ]
        return spark.createDataFrame(rows, MODEL_SCHEMA)


def save_model(model: Model, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    """Write the model table once (one file)."""
    model.validate().to_frame(spark).coalesce(1).write.mode(mode).parquet(path)


def model_from_frame(df: DataFrame) -> Model:
    rows = df.orderBy("cluster").limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError("model table too large")
    if [r["cluster"] for r in rows] != list(range(len(rows))):
        raise ValueError("cluster numbers must be 0..k-1")
    versions = {r["version"] or 1 for r in rows}
    if versions - {1, VERSION} or len(versions) > 1:
        raise ValueError(f"model table of versions {sorted(versions)}; up to {VERSION} is known")
    if len({(tuple(r["weights"] or ()), r["lexicon_digest"]) for r in rows}) > 1:
        raise ValueError("the rows of a model must agree on weights and phrase lists")
    flags = [r["cluster"] for r in rows if r["is_ai"]]
    if len(flags) != 1:
        raise ValueError("exactly one cluster must be marked is_ai")
    first = rows[0]
    return Model(
        centroids=[list(r["centroid"]) for r in rows],
        ai_cluster=flags[0],
        inertia=first["inertia"],
        n_iter=first["n_iter"],
        converged=first["converged"],
        run=first["run"],
        weights=list(first["weights"]) if first["weights"] is not None else None,
        lexicons={f: list(p) for f, p in first["lexicons"].items()} if first["lexicons"] else None,
        lexicon_digest=first["lexicon_digest"],
    ).validate()


def load_model(spark: SparkSession, path: str) -> Model:
    return model_from_frame(spark.read.schema(MODEL_SCHEMA).parquet(path))


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """The model as a DataFrame with one column per feature (for display)."""
    df = model.to_frame(spark)
    return df.select(
        "cluster", "is_ai",
        *[F.col("centroid")[i].alias(f"c{i}") for i in range(lexicon.N_FEATURES)],
        "inertia", "n_iter", "converged", "run",
    )
