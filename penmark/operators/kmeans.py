"""k-means under the L-infinity distance, as a distributed DataFrame loop.

Spark ML's KMeans only knows Euclidean and cosine distance, so the loop is
written with DataFrame operations:

* **compaction**: identical feature vectors are grouped into one weighted
  point (``groupBy(f0..f14).count()``, map-side combined, so a hot vector
  such as all-zeros collapses inside each task before the shuffle). Means,
  assignments and inertia are the same as over the raw rows; every later
  pass scans the compact table, written once to the shared folder.
* **centres as a constant**: each round's centres (one struct per run,
  ``runs`` is capped) are unnested next to every point, so each point is
  scored once per run without any join. Only the constant changes between
  rounds, so Spark reuses the compiled code and the lineage never grows.
* **seeding** (k-means++, weight = distance to the nearest chosen centre):
  a weighted pick by exponential race, ``argmin(-ln(u) / (w·d))`` with
  ``u`` from the md5 of the point (features in millionths), the run, the
  centre's number and the seed, so the pick does not depend on partitioning
  and any engine can repeat it. One grouped aggregate per centre for all runs.
* **Lloyd rounds**: nearest centre by L∞ (ties to the lower index), means
  by one aggregate per round over ``(run, cluster)`` for all unconverged
  runs at once: partial aggregation leaves at most ``runs × k`` rows per
  task to shuffle. An empty cluster keeps its centre; a run stops when no
  centre coordinate moves more than ``tol`` or after ``max_iter`` rounds.
* **restarts**: keep the run with the lowest inertia (mean distance to the
  nearest centre) to nine places, ties to the lower run number. Runs that
  reach the same centres differ in the last bits only, by the order of the
  sums; rounded, they tie, and the choice does not depend on partitioning.

Only ``runs × k × 15`` doubles ever reach the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.features import linf_to_point

FEATS = lexicon.FEATURE_NAMES
DIM = len(FEATS)
UNIT = 2.0**52  # 13 hexadecimal digits of a md5
GRAIN = 1e6  # a point's features are hashed in millionths
INERTIA_PLACES = 9
MAX_RUNS = 1000  # each point is scored once per run: keep the constant small
MAX_K = 256


@dataclass
class KMeansResult:
    centroids: list[list[float]]
    inertia: float
    run: int
    n_iter: int
    converged: bool
    runs: list[dict] = field(default_factory=list)
    # per cluster of the chosen run, at the final centres: member weight and
    # the weighted sum of the first feature (for naming the clusters)
    cluster_stats: list[dict] = field(default_factory=list)


# ------------------------------------------------------------ column forms
def compact(features: DataFrame, weight: str | None = None) -> DataFrame:
    """(f0..f14, w): one row per distinct feature vector, w = number of rows.

    Rows must have non-null features (drop null texts before computing the
    metrics, as :func:`penmark.plans.pipeline.feature_table` does). No null
    filter is applied here on purpose: Catalyst would push it below the
    metric projection and evaluate every metric twice."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    return features.groupBy(*FEATS).agg(w.cast("double").alias("w"))


def assign_expr(centres: list[list[float]]) -> Column:
    """Index of the nearest centre (literal centres); ties go to the lower index; null without features."""
    ds = [linf_to_point(c) for c in centres]
    if len(ds) == 1:
        return F.lit(0)
    if len(ds) == 2:
        return F.when(ds[0] <= ds[1], F.lit(0)).when(ds[0] > ds[1], F.lit(1))
    arr = F.array(*ds)
    return F.array_position(arr, F.array_min(arr)).cast("int") - 1


def min_distance_expr(centres: list[list[float]]) -> Column:
    ds = [linf_to_point(c) for c in centres]
    return ds[0] if len(ds) == 1 else F.least(*ds)


def predict(df: DataFrame, centroids: list[list[float]], out: str = "cluster") -> DataFrame:
    """Nearest centre per row: a projection, no shuffle."""
    return df.withColumn(out, assign_expr(centroids))


# --------------------------------------------------------------- SQL forms
def _dist_sql(j: int) -> str:
    return "greatest(" + ", ".join(f"abs(p.f{i} - c.c{j}_{i})" for i in range(DIM)) + ")"


def _label_sql(k: int) -> str:
    if k == 1:
        return "0"
    if k == 2:
        return f"CASE WHEN {_dist_sql(0)} <= {_dist_sql(1)} THEN 0 ELSE 1 END"
    ds = ", ".join(_dist_sql(j) for j in range(k))
    return f"array_position(array({ds}), array_min(array({ds}))) - 1"


def _mindist_sql(k: int) -> str:
    if k == 1:
        return _dist_sql(0)
    return "least(" + ", ".join(_dist_sql(j) for j in range(k)) + ")"


def _num(v: float) -> str:
    """A Spark SQL double literal that round-trips exactly."""
    return f"{float(v)!r}D"


class _Loop:
    """Holds the points view and the fixed SQL shapes of one fit. Centres
    enter each statement as a constant array of structs unnested next to
    every point (``LATERAL VIEW explode``; no join). Constant folding makes
    the array one literal that generated code only references, so the code
    compiled in the first round is reused by all later ones."""

    def __init__(self, points: DataFrame, k: int):
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must be in 1..{MAX_K}")
        self.spark = points.sparkSession
        self.k = k
        self.pv = f"_penmark_points_{uuid.uuid4().hex[:12]}"
        points.createOrReplaceTempView(self.pv)
        sums = ", ".join(f"sum(p.f{i} * p.w) AS f{i}" for i in range(DIM))
        self.step_sql = (
            f"SELECT c.run AS run, {_label_sql(k)} AS cluster, sum(p.w) AS n, {sums} "
            f"FROM {self.pv} p {{centres}} GROUP BY 1, 2"
        )
        self.inertia_sql = (
            f"SELECT c.run AS run, sum({_mindist_sql(k)} * p.w) / sum(p.w) AS inertia "
            f"FROM {self.pv} p {{centres}} GROUP BY 1"
        )
        self.final_sql = (
            f"SELECT c.run AS run, {_label_sql(k)} AS cluster, sum(p.w) AS n, "
            f"sum({_mindist_sql(k)} * p.w) AS dist_sum, sum(p.f0 * p.w) AS f0_sum "
            f"FROM {self.pv} p {{centres}} GROUP BY 1, 2"
        )

    def centres_sql(self, centres: dict[int, list[list[float]]], k: int | None = None) -> str:
        k = self.k if k is None else k
        structs = ", ".join(
            "named_struct('run', " + str(int(r)) + ", "
            + ", ".join(f"'c{j}_{i}', {_num(v)}" for j, c in enumerate(centres[r][:k]) for i, v in enumerate(c))
            + ")"
            for r in sorted(centres)
        )
        return f"LATERAL VIEW explode(array({structs})) t AS c"

    def step(self, centres: dict[int, list[list[float]]]):
        new = {r: [list(c) for c in centres[r]] for r in centres}
        counts = {r: [0.0] * self.k for r in centres}
        for row in self.spark.sql(self.step_sql.format(centres=self.centres_sql(centres))).collect():
            n = row["n"]
            if n and n > 0:
                new[row["run"]][row["cluster"]] = [row[f] / n for f in FEATS]
                counts[row["run"]][row["cluster"]] = float(n)
        return new, counts

    def inertia(self, centres: dict[int, list[list[float]]]) -> dict[int, float]:
        sql = self.inertia_sql.format(centres=self.centres_sql(centres))
        return {row["run"]: float(row["inertia"]) for row in self.spark.sql(sql).collect()}

    def final(self, centres: dict[int, list[list[float]]]):
        """One job at the final centres: inertia per run and, per (run,
        cluster), the member weight and weighted first-feature sum."""
        rows = self.spark.sql(self.final_sql.format(centres=self.centres_sql(centres))).collect()
        stats = {r: [{"cluster": c, "n": 0.0, "f0_sum": 0.0} for c in range(self.k)] for r in centres}
        dist = {r: 0.0 for r in centres}
        weight = {r: 0.0 for r in centres}
        for row in rows:
            stats[row["run"]][row["cluster"]] = {"cluster": row["cluster"], "n": float(row["n"]), "f0_sum": float(row["f0_sum"])}
            dist[row["run"]] += row["dist_sum"]
            weight[row["run"]] += row["n"]
        inertia = {r: (dist[r] / weight[r] if weight[r] else float("nan")) for r in centres}
        return inertia, stats

    def seed(self, runs: int, seed: int) -> dict[int, list[list[float]]]:
        """k-means++ picks for all runs: k grouped aggregates."""
        vec = "array(" + ", ".join(f"p.f{i}" for i in range(DIM)) + ")"
        point = ", ".join(f"CAST(floor(p.f{i} * {_num(GRAIN)} + 0.5D) AS BIGINT)" for i in range(DIM))
        chosen: dict[int, list[list[float]]] = {r: [] for r in range(runs)}
        for j in range(self.k):
            if j == 0:
                weight = "p.w"
                rel = "LATERAL VIEW explode(array(" + ", ".join(f"named_struct('run', {r})" for r in range(runs)) + ")) t AS c"
            else:
                near = _dist_sql(0) if j == 1 else "least(" + ", ".join(_dist_sql(i) for i in range(j)) + ")"
                weight = f"p.w * {near}"
                rel = self.centres_sql(chosen, k=j)
            drawn = f"conv(substr(md5(concat_ws(',', {point}, c.run, {j}, {int(seed)})), 1, 13), 16, 10)"
            u = f"((CAST({drawn} AS BIGINT) + 1.0D) / {_num(UNIT)})"
            key = f"CASE WHEN {weight} > 0 THEN named_struct('k', -ln({u}) / ({weight}), 't', {vec}) END"
            sql = (
                f"SELECT c.run AS run, min_by({vec}, {key}) AS pick "
                f"FROM {self.pv} p {rel} GROUP BY 1"
            )
            picks = {row["run"]: row["pick"] for row in self.spark.sql(sql).collect()}
            if j == 0 and not any(v is not None for v in picks.values()):
                raise ValueError("cannot fit k-means on an empty input")
            for r in range(runs):
                c = picks.get(r)
                if c is None:  # fewer distinct points than k: repeat the last centre
                    c = chosen[r][-1]
                chosen[r].append([float(v) for v in c])
        return chosen

    def close(self) -> None:
        self.spark.catalog.dropTempView(self.pv)


def _shift(a: list[list[float]], b: list[list[float]]) -> float:
    return max(abs(x - y) for ca, cb in zip(a, b) for x, y in zip(ca, cb))


# ------------------------------------------------------------ public steps
def seed_centres(points: DataFrame, k: int, runs: int, seed: int) -> list[list[list[float]]]:
    """k-means++ starting centres for every run, ``[run][cluster][feature]``."""
    loop = _Loop(points, k)
    try:
        s = loop.seed(runs, seed)
        return [s[r] for r in range(runs)]
    finally:
        loop.close()


def lloyd_step_counts(points: DataFrame, centres: dict[int, list[list[float]]]):
    """One Lloyd round for the given runs; new centres and member weights."""
    loop = _Loop(points, len(next(iter(centres.values()))))
    try:
        return loop.step(centres)
    finally:
        loop.close()


def lloyd_step(points: DataFrame, centres: dict[int, list[list[float]]]) -> dict[int, list[list[float]]]:
    return lloyd_step_counts(points, centres)[0]


def inertia(points: DataFrame, centres: dict[int, list[list[float]]]) -> dict[int, float]:
    """Weighted mean distance to the nearest centre, per run (one job)."""
    loop = _Loop(points, len(next(iter(centres.values()))))
    try:
        return loop.inertia(centres)
    finally:
        loop.close()


def fit_points(
    points: DataFrame,
    k: int = lexicon.DEFAULT_K,
    runs: int = lexicon.DEFAULT_RUNS,
    max_iter: int = lexicon.DEFAULT_MAX_ITER,
    tol: float = lexicon.DEFAULT_TOL,
    seed: int = lexicon.DEFAULT_SEED,
    init: list[list[float]] | None = None,
) -> KMeansResult:
    """Fit on a compact (f0..f14, w) table (see :func:`compact`)."""
    if k < 1 or not 1 <= runs <= MAX_RUNS:
        raise ValueError(f"k must be positive and runs in 1..{MAX_RUNS}")
    loop = _Loop(points, k)
    try:
        if init is not None:
            current = {r: [list(map(float, c)) for c in init] for r in range(runs)}
        else:
            current = loop.seed(runs, seed)
        active = set(range(runs))
        n_iter = {r: 0 for r in range(runs)}
        converged = {r: False for r in range(runs)}
        for _ in range(max_iter):
            if not active:
                break
            step, _counts = loop.step({r: current[r] for r in sorted(active)})
            for r, c in step.items():
                n_iter[r] += 1
                moved = _shift(current[r], c)
                current[r] = c
                if moved < tol:
                    converged[r] = True
                    active.discard(r)
        scores, stats = loop.final(current)
    finally:
        loop.close()
    best = min(range(runs), key=lambda r: (round(scores[r], INERTIA_PLACES), r))
    return KMeansResult(
        centroids=current[best],
        inertia=scores[best],
        run=best,
        n_iter=n_iter[best],
        converged=converged[best],
        runs=[
            {"run": r, "inertia": scores[r], "n_iter": n_iter[r], "converged": converged[r]}
            for r in range(runs)
        ],
        cluster_stats=stats[best],
    )


def fixed_rounds(points: DataFrame, init: list[list[float]], rounds: int):
    """Exactly ``rounds`` Lloyd rounds from ``init`` (no convergence stop).
    Returns the centres and the member weights of the last round."""
    loop = _Loop(points, len(init))
    try:
        cur = {0: [list(map(float, c)) for c in init]}
        counts = {0: [0.0] * len(init)}
        for _ in range(rounds):
            cur, counts = loop.step(cur)
        return cur[0], counts[0]
    finally:
        loop.close()
