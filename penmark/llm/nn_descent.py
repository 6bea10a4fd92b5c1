"""Embedding near-duplicates by NN-descent.

Vectors of one label are compared by cosine, in double precision. Rows with
the same label and vector form one node. The neighbour graph starts from
random orders: nodes sorted by the signs of random projections, each compared
with the few before it; the number of orders grows with the largest label as
the chance of a linked pair to share a prefix falls. A round then joins the
lists of neighbours and of those that have the node in their list: neighbours
of a neighbour are compared, if the two did not meet there the round before,
and every node keeps its best, whatever their cosine, so the descent can walk
to links from afar. A list that is full of links (saturated) is enlarged, twice
as long each time, up to ``LONGEST``. Rounds end when few lists change. Links
(cosine of at least the threshold) found at any time are kept.

Audit: hash samples of nodes are compared with all nodes, and the sample grows
until ``LINKED`` of its nodes have a link, or it holds all nodes. The recall is
the share of its links that lie within a component of the graph. Links lacking
are added. While the recall is below ``RECALL`` the descent is run again from
new random orders and audited on a fresh sample; after ``TRIES`` all nodes are
compared with all of their label. ``linked_components`` returns the recalls.

Counts: a link lies within one component, so each component's members are
compared in blocks of ``BLOCK``, by matrix products that yield counts, never
pairs. So saturated lists need not hold all links of a large group, and groups
are split over tasks.

Defined cases: vectors that are null, empty, zero, or hold a null or a number
that is not finite, and rows without a label, link with nothing; vectors of
other lengths are compared only with their like; rows that repeat a label and
a vector link with each other; rows of one vec_id are rows of their own; a
component's id is its smallest vec_id; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written
from .components import components

THRESHOLD = 0.93
ORDERS = 8
BITS = 62
BEFORE = 4
FEW = 1000  # nodes of a label that ORDERS is meant for
LIST = 8
LONGEST = 32
CHANGED = 0.01
AUDIT = 1000  # nodes of an audit's first sample
LARGEST = 16_000  # nodes of a sample that is held at once
LINKED = 500
RECALL = 0.999
TRIES = 3
BLOCK = 1024


def _units(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Binary vectors as unit rows, in double precision."""
    rows = [np.frombuffer(b, np.float32, len(b) // 4) if len(b) % 4 else np.frombuffer(b, np.float64) for b in (x.as_buffer() for x in column)]
    x = np.array(rows, np.float64) if rows else np.zeros((0, dim or 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, node or null; nodes: node, place, vec, copies). The
    vector is binary float64, or float32 and one byte more if the input holds
    floats; ``place`` names the label and length."""
    ship(vectors.sparkSession)
    short = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    e = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), e.alias("e"), F.coalesce(good, F.lit(False)).alias("good"))
    key = F.struct("label", F.transform("e", lambda x: x + F.lit(0.0)).alias("e"))  # -0.0 is 0.0
    rows = rows.select("vec_id", F.when(F.col("good"), F.sha2(F.to_json(key), 256)).alias("key"), "label", "e")
    rows = written(rows, "vectors")
    kinds = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("e").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = pa.array([np.array(x, np.float32).tobytes() + b"f" if short else np.array(x, np.float64).tobytes() for x in batch.column("e").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "place", "least", "copies")] + [vec], names=["node", "place", "least", "copies", "vec"])

    place = F.xxhash64("label", F.size("e"))
    kinds = kinds.select(F.xxhash64("key").alias("node"), place.alias("place"), "least", "copies", "e")
    nodes = written(kinds.mapInArrow(pack, "node long, place long, least long, copies long, vec binary"), "vector-nodes")
    return rows.select("vec_id", F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("node")), nodes


def _orders(nodes: DataFrame, threshold: float) -> int:
    """A linked pair shares the log2(n) bits that tell n nodes apart with a
    chance of n to the power of log2(1 - angle / pi); orders make up for it."""
    most = nodes.groupBy("place").count().agg(F.max("count")).first()[0] or 0
    power = -math.log2(1 - math.acos(max(-0.9, min(1.0, threshold))) / math.pi)
    return math.ceil(ORDERS * max(1.0, most / FEW) ** power)


def _first_lists(nodes: DataFrame, seed: int, orders: int) -> DataFrame:
    """Pairs (a, b, cos) of nodes near each other in a random order."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                some = batch.slice(first, 2048)
                vecs = some.column("vec")
                for size in {len(x.as_buffer()) for x in vecs}:
                    own = some.filter(pa.array([len(x.as_buffer()) == size for x in vecs]))
                    x = _units(own.column("vec"))
                    for order in range(orders):
                        planes = np.random.default_rng([seed, order, size]).standard_normal((x.shape[1], BITS))
                        key = ((x @ planes) > 0) @ (np.int64(1) << np.arange(BITS, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(x), order), pa.int32()), own.column("place"), pa.array(key, pa.int64()), own.column("node"), own.column("vec")],
                            names=["ord", "place", "key", "node", "vec"],
                        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                some = batch.slice(first, 4096)
                if held is not None:
                    some = pa.Table.from_batches([held, some]).combine_chunks().to_batches()[0]
                held = some.slice(max(0, some.num_rows - BEFORE))
                order, place, node = (some.column(c).to_numpy() for c in ("ord", "place", "node"))
                size = np.array([len(x.as_buffer()) for x in some.column("vec")])
                for one in np.unique(size):
                    own = np.flatnonzero(size == one)
                    units, row = _units(some.column("vec").take(pa.array(own))), np.cumsum(size == one) - 1
                    for back in range(1, BEFORE + 1):
                        at = np.flatnonzero((order[back:] == order[:-back]) & (place[back:] == place[:-back]) & (size[back:] == one)) if len(order) > back else np.zeros(0, int)
                        cos = np.einsum("ij,ij->i", units[row[at]], units[row[at + back]])
                        yield pa.RecordBatch.from_arrays([pa.array(node[at], pa.int64()), pa.array(node[at + back], pa.int64()), pa.array(cos)], names=["a", "b", "cos"])

    rows = nodes.select("node", "place", "vec").mapInArrow(signs, "ord int, place long, key long, node long, vec binary")
    rows = rows.repartitionByRange("ord", "place", "key", "node").sortWithinPartitions("ord", "place", "key", "node")
    return rows.mapInArrow(compare, "a long, b long, cos double")


def _best(pairs: DataFrame, limits: DataFrame | None) -> DataFrame:
    """The best of each node's list: node, near, cos, limit."""
    rows = pairs.select(F.col("a").alias("node"), F.col("b").alias("near"), "cos")
    if limits is None:
        rows = rows.withColumn("limit", F.lit(LIST))
    else:
        rows = rows.join(limits.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").drop("l_node")
        rows = rows.withColumn("limit", F.coalesce("limit", F.lit(LIST)))
    order = Window.partitionBy("node").orderBy(F.col("cos").desc(), "near")
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LONGEST)  # bounded before the shuffle
    return rows.where("nth <= limit").drop("nth")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))


def _descend(nodes: DataFrame, seed: int, threshold: float) -> DataFrame:
    """All links found: a, b with a < b."""
    pairs = _first_lists(nodes, seed, _orders(nodes, threshold)).where("a <> b")
    pairs = written(_both(pairs).groupBy("a", "b").agg(F.max("cos").alias("cos")), "nn-pairs")
    links = [pairs.where((F.col("cos") >= threshold) & (F.col("a") < F.col("b"))).select("a", "b")]
    lists = written(_best(pairs, None), "nn-lists")
    met_before = None
    while True:  # lists only get better or longer, up to LONGEST
        # a list full of links is saturated
        full = lists.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("worst"), F.max("limit").alias("limit"))
        saturated = (F.col("n") >= F.col("limit")) & (F.col("worst") >= threshold) & (F.col("limit") < LONGEST)
        full = full.select("node", "n", "worst", "limit", F.when(saturated, F.least(2 * F.col("limit"), F.lit(LONGEST))).otherwise(F.col("limit")).cast("int").alias("next"))
        limits = full.select("node", F.col("next").alias("limit"))
        # a pair that betters neither list need not be told
        worst = full.select(F.col("node").alias("w_node"), F.when(F.col("n") >= F.col("next"), F.col("worst")).otherwise(-2.0).alias("worst"))
        # both directions; the reverse list is cut to as many
        back = lists.select(F.col("near").alias("node"), F.col("node").alias("near"), "cos")
        order = Window.partitionBy("node").orderBy(F.col("cos").desc(), "near")
        back = back.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LIST).drop("nth")
        around = written(lists.select("node", "near").unionByName(back.select("node", "near")).distinct(), "nn-around")
        if met_before is None:
            flagged = around.withColumn("old", F.lit(False))
        else:
            flagged = around.join(met_before.withColumn("was", F.lit(True)), ["node", "near"], "left").select("node", "near", F.coalesce("was", F.lit(False)).alias("old"))
            fresh = around.join(met_before, ["node", "near"], "left_anti").select("node").distinct()
            flagged = flagged.join(fresh, "node", "left_semi")
        met_before = around
        vecs = nodes.select(F.col("node").alias("v_node"), "vec")
        asked = flagged.join(worst, F.col("near") == F.col("w_node"), "left").join(vecs, F.col("near") == F.col("v_node"))
        asked = asked.groupBy("node").agg(F.collect_list(F.struct("near", "old", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "vec")).alias("all"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row in batch.column("all"):
                    near, vec = row.values.field("near").to_numpy(), _units(row.values.field("vec"))
                    old, least = row.values.field("old").to_numpy(zero_copy_only=False), row.values.field("worst").to_numpy()
                    cos = vec @ vec.T
                    told = (cos >= threshold) | (cos > np.minimum(least[:, None], least[None, :]))
                    i, j = np.nonzero(np.triu(told & ~(old[:, None] & old[None, :]), 1))
                    found.append((near[i], near[j], cos[i, j]))
                if found:
                    a, b, c = (np.concatenate(x) for x in zip(*found))
                    low, high = np.minimum(a, b), np.maximum(a, b)
                    keep = np.unique(np.stack([low, high], 1), axis=0, return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([pa.array(low[keep]), pa.array(high[keep]), pa.array(c[keep])], names=["a", "b", "cos"])

        met = written(asked.select("all").mapInArrow(meet, "a long, b long, cos double").groupBy("a", "b").agg(F.max("cos").alias("cos")), "nn-pairs")
        links.append(met.where(F.col("cos") >= threshold).select("a", "b"))
        known = lists.select(F.col("node").alias("a"), F.col("near").alias("b"), "cos")
        pool = known.unionByName(_both(met)).groupBy("a", "b").agg(F.max("cos").alias("cos"))
        last, lists = lists, written(_best(pool, limits), "nn-lists")
        changed = lists.join(last.select("node", "near"), ["node", "near"], "left_anti").count()
        if changed <= CHANGED * max(1, lists.count()):
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return written(out.distinct(), "nn-links")


SPREAD = 1 << 40


def _true_links(nodes: DataFrame, threshold: float, seed: int, first: int, after: int) -> DataFrame:
    """The true links (a, b, asked: the one of the sample) of the nodes whose
    hash lies in [first, after) of ``SPREAD``, by comparing them with all."""
    at = F.pmod(F.xxhash64("node", F.lit(seed + 3)), F.lit(SPREAD))
    chosen = nodes.where((at >= first) & (at < after)).select("node", "place", "vec")
    rows = sorted((r.place, len(r.vec), r.node, bytes(r.vec)) for r in chosen.collect())  # about LARGEST rows at most
    asked: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    by_key: dict[tuple[int, int], list[tuple]] = {}
    for r in rows:
        by_key.setdefault(r[:2], []).append(r)
    for key, own in by_key.items():
        asked[key] = np.array([r[2] for r in own]), _units(pa.array([r[3] for r in own], pa.binary()))
    held = nodes.sparkSession.sparkContext.broadcast(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                some = batch.slice(start, 2048)
                where = [(p, len(v.as_buffer())) for p, v in zip(some.column("place").to_pylist(), some.column("vec"))]
                for key in set(where) & held.value.keys():
                    own = some.filter(pa.array([w == key for w in where]))
                    names, units = held.value[key]
                    i, j = np.nonzero(_units(own.column("vec")) @ units.T >= threshold)
                    a, b = own.column("node").to_numpy()[i], names[j]
                    keep = a != b
                    a, b = a[keep], b[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(b)], names=["a", "b", "asked"])

    return written(nodes.select("node", "place", "vec").mapInArrow(compare, "a long, b long, asked long"), "nn-audit")


def _audited(nodes: DataFrame, threshold: float, seed: int, wanted: float) -> tuple[DataFrame, int, bool]:
    """(true links of a sample, its linked nodes, whether it holds all nodes).
    The sample grows until ``wanted`` of its nodes are linked."""
    total = max(1, nodes.count())
    first, size, linked, found = 0, AUDIT, 0, []
    while first < SPREAD and (not found or linked < wanted):
        after = min(SPREAD, first + max(1, SPREAD * size // total))
        found.append(_true_links(nodes, threshold, seed, first, after))
        linked += found[-1].select("asked").distinct().count()
        first, size = after, min(2 * size, LARGEST)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("a", "b").distinct(), linked, first >= SPREAD


def audit(nodes: DataFrame, threshold: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """The true links (a, b) of a hash sample with enough linked nodes, by
    comparing the sample with all nodes."""
    return _audited(nodes, threshold, seed, LINKED)[0]


def linked_components(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[dict]]:
    """(node, comp of all linked nodes; one report per audit: linked nodes,
    links and recall of the sample, and whether the links are now all)."""
    links = _descend(nodes, 0, threshold)
    reports: list[dict] = []
    for seed in range(TRIES):
        comps = components(links)
        true, linked, whole = _audited(nodes, threshold, seed, LINKED)
        lacking = true.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
        lacking = lacking.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        # a link that is not listed but lies within a component is counted later
        n, lost = lacking.agg(F.count(F.lit(1)), F.count(F.when(F.expr("ca IS NULL OR cb IS NULL OR ca <> cb"), 1))).first()
        reports.append({"linked": linked, "links": n, "recall": 1 - lost / n if n else 1.0, "exact": whole})
        logging.getLogger(__name__).info("audit %d: %s", seed, reports[-1])
        if not lost:
            return comps, reports
        links = links.unionByName(true)
        if whole or reports[-1]["recall"] >= RECALL:
            return components(links), reports
        if seed + 1 < TRIES:
            links = written(links.unionByName(_descend(nodes, seed + 1, threshold)).distinct(), "nn-links")
    links = links.unionByName(_audited(nodes, threshold, TRIES, math.inf)[0])
    reports[-1]["exact"] = True
    return components(links), reports


def _counts(nodes: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """Rows linked with each node's rows in its component: node, linked."""
    rows = nodes.join(comps, "node").select("node", "comp", "copies", "vec")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK)
    rows = rows.join(sizes, "comp").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # each block meets every block of its component; pairs of blocks are the groups
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    rows = rows.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "vec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, row in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("all")):
                values = row.values
                block, node, copies = (values.field(c).to_numpy() for c in ("block", "node", "copies"))
                units = _units(values.field("vec"))
                left, right = block == x, block == y
                near = units[left] @ units[right].T >= threshold
                if x == y:
                    near |= np.eye(len(near), dtype=bool)
                out = [(node[left], near @ copies[right])]
                if x != y:
                    out.append((node[right], copies[left] @ near))
                a, n = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64())], names=["node", "linked"])

    groups = rows.groupBy("comp", "x", "y").agg(F.collect_list(F.struct("block", "node", "copies", "vec")).alias("all"))  # two blocks each
    return groups.select("x", "y", "all").mapInArrow(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows, nodes = _nodes(vectors)
    comps, _ = linked_components(nodes, threshold)
    linked = _counts(nodes, comps, threshold)
    found = nodes.join(comps, "node", "left").join(linked, "node", "left")
    found = found.select("node", "least", F.coalesce("comp", "node").alias("comp"), (F.coalesce("linked", "copies") - 1).alias("n"))
    least = found.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = found.join(least, "comp").select(F.col("node").alias("f_node"), "n", F.col("component_id").alias("c"))
    out = rows.join(found, F.col("node") == F.col("f_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT m.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
