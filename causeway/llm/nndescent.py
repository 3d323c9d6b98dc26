"""Near-duplicate vectors of one label by NN-descent.

Neighbour lists start from several sorted orders of sign projections and are refined by comparing the
neighbours of each vector with each other. Saturated lists (all of whose places hold links) are enlarged to
their whole component, block by block. A sample of vectors is compared with all others to measure recall; if
that is too low, more orders are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.llm.common import Scratch, small_batches
from causeway.llm.graph import components

LINK = 0.98
#: Neighbours below this aren't listed: two vectors with a common neighbour nearer than this may be a link.
FLOOR = 0.90
#: Orders added at a time, bits of each, and places down each order that a vector is compared with.
ORDERS, BITS, REACH = 16, 48, 3
LIST = 12
ROUNDS, STILL = 4, 0.01
#: Vectors in a block of a component that is compared as a whole.
BLOCK = 512
#: Vectors compared with all others, the recall below which orders are added, how often at most, and the recall below which there is no result.
AUDIT, RECALL, TRIES, LEAST = 512, 0.999, 3, 0.9


def _matrix(vectors) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _sort_key(x: np.ndarray, order: int) -> np.ndarray:
    planes = np.random.default_rng([17, order, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return (x @ planes > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])


def seeds(nodes: DataFrame, first: int, orders: int = ORDERS) -> DataFrame:
    """(u, v, sim): what stands close together in some order; rows in proportion to the vectors."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(b["vec"].map(len)):
                x = _matrix(g["vec"])
                for k in range(first, first + orders):
                    yield pd.DataFrame({"k": k, "kind": g["kind"], "at": _sort_key(x, k), "node": g["node"], "vec": g["vec"]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            rest = b.tail(REACH)
            yield from _close(b)

    kind = f"k int, kind string, at long, node long, vec {nodes.schema['vec'].dataType.simpleString()}"
    laid = nodes.mapInPandas(spread, kind).repartitionByRange(parts, "k", "kind", "at").sortWithinPartitions("k", "kind", "at", "node")
    return laid.mapInPandas(meet, "u long, v long, sim double").groupBy("u", "v").agg(F.max("sim").alias("sim"))


def _close(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = b["vec"].map(len).to_numpy()
    turns = lambda x: np.r_[True, x[1:] != x[:-1]]
    start = np.flatnonzero(turns(b["k"].to_numpy()) | turns(b["kind"].to_numpy()) | turns(size)).tolist() if len(b) else []
    for i, j in zip(start, start[1:] + [len(b)], strict=True):
        x, node = _matrix(b["vec"].iloc[i:j]), b["node"].to_numpy()[i:j]
        for step in range(1, min(REACH, j - i - 1) + 1):
            yield _pairs(node[:-step], node[step:], (x[:-step] * x[step:]).sum(1), FLOOR)


def _pairs(a: np.ndarray, b: np.ndarray, sim: np.ndarray, least: float) -> pd.DataFrame:
    keep = (sim >= least) & (a != b)
    a, b, sim = a[keep], b[keep], sim[keep]
    return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b), "sim": sim})


def descend(edges: DataFrame, nodes: DataFrame, scratch: Scratch, size: int = LIST) -> DataFrame:
    """More (u, v, sim): each vector's listed neighbours are compared with each other, until little is new."""
    both = edges.union(edges.select("v", "u", "sim"))
    for _ in range(ROUNDS):
        best = both.withColumn("n", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("n") <= size).select("u", F.col("v").alias("node"))
        held = best.join(nodes.select("node", "vec"), "node").repartition("u").sortWithinPartitions("u", "node")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rest = None
            for b in batches:
                b = b if rest is None else pd.concat([rest, b], ignore_index=True)
                last = b["u"].iloc[-1] if len(b) else None
                rest = b[b["u"] == last]
                yield from _neighbours(b[b["u"] != last])
            if rest is not None:
                yield from _neighbours(rest)

        old, met = edges, held.mapInPandas(compare, "u long, v long, sim double")
        edges = scratch.write(old.withColumn("old", F.lit(1)).unionByName(met.withColumn("old", F.lit(0))).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old")))
        counts = edges.agg(F.count("*").alias("n"), F.count_if(F.col("old") == 0).alias("new")).first()
        edges = edges.drop("old")
        both = edges.union(edges.select("v", "u", "sim"))
        if counts.new <= STILL * counts.n:
            break
    return edges


def _neighbours(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    found = []
    for _, g in b.groupby("u", sort=False):
        if len(g) > 1:
            x, node = _matrix(g["vec"]), g["node"].to_numpy()
            i, j = np.triu_indices(len(g), 1)
            found.append(_pairs(node[i], node[j], (x @ x.T)[i, j], FLOOR))
    if found:
        yield pd.concat(found, ignore_index=True)


def enlarge(nodes: DataFrame, found: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(node, linked): the sum of copies over all vectors of the node's component that are links, the node left out.

    A component of more than `block` vectors is dealt out as pairs of blocks; a task holds two blocks at most
    and returns counts, not pairs.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    cut = found.join(sizes, "component").select("node", "component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    task = other.select("node", "block", "component", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"))
    held = task.join(nodes.select("node", "vec", "copies"), "node")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        names = ["component", "lo", "hi"]
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = b[names].iloc[-1]
            here = (b[names] == last).all(axis=1)
            rest = b[here]
            yield from _counted(b[~here], names)
        if rest is not None:
            yield from _counted(rest, names)

    laid = held.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "node")
    return scratch.write(laid.mapInPandas(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked")))


def _counted(b: pd.DataFrame, names: list[str]) -> Iterator[pd.DataFrame]:
    out = []
    for (_, lo, hi), g in b.groupby(names, sort=False):
        x, node, copies, at = _matrix(g["vec"]), g["node"].to_numpy(), g["copies"].to_numpy(), g["block"].to_numpy()
        linked = x @ x.T >= LINK
        np.fill_diagonal(linked, False)
        if lo != hi:
            linked &= at[:, None] != at[None, :]
        out.append(pd.DataFrame({"node": node, "linked": linked @ copies}))
    if out:
        yield pd.concat(out, ignore_index=True)


def audit(nodes: DataFrame, found: DataFrame, sample: int = AUDIT) -> float:
    """How much of the true links of `sample` vectors (those whose hashed keys come first) lies in one component: the mean share over those that have links."""
    picked = nodes.select("node").orderBy(F.xxhash64("node", F.lit(3)), "node").limit(sample)
    picked = nodes.join(F.broadcast(picked), "node", "left_semi").select("node", "kind", "vec").collect()  # AUDIT vectors
    if not picked:
        return 1.0
    by_kind: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for kind in {r.kind for r in picked}:
        mine = [r for r in picked if r.kind == kind]
        by_kind[kind] = (np.array([r.node for r in mine], np.int64), _matrix([r.vec for r in mine]))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, g in b.groupby("kind"):
                if kind in by_kind:
                    node, q = by_kind[kind]
                    own = g["node"].to_numpy()
                    i, j = np.nonzero((_matrix(g["vec"]) @ q.T >= LINK) & (own[:, None] != node))
                    yield pd.DataFrame({"u": node[j], "v": own[i]})

    true = nodes.select("node", "kind", "vec").mapInPandas(look, "u long, v long")
    a, b = found.toDF("u", "cu"), found.toDF("v", "cv")
    shares = true.join(a, "u", "left").join(b, "v", "left").groupBy("u").agg((F.count_if(F.col("cu") == F.col("cv")) / F.count("*")).alias("share"))
    return shares.agg(F.avg("share").alias("r")).first().r or (1.0 if true.isEmpty() else 0.0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", orders: int = ORDERS) -> DataFrame:
    """A row for each input row: id_col, n_links, component_id, kept, recall.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is
    at least LINK, recall being the share of true links that the audit found. Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, and vectors of different lengths never link. Equal vectors are worked on once. A row without id
    is counted as a link by others; component_id is null only if no row of the component has an id. Repeated
    rows are rows of their own; an empty table gives an empty one. Other columns aren't read. If the audit
    finds less than LEAST after TRIES times `orders` orders, there is no result but an error.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "nndescent")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & F.coalesce(_valid(F.col("vec")), F.lit(False))
    told = F.concat_ws("|", F.size("vec").cast("string"), F.col("label").cast("string"))
    keyed = rows.select("id", F.when(good, F.sha2(F.concat_ws("|", told, F.col("vec").cast("string")), 256)).alias("key"), F.when(good, told).alias("kind"), F.when(good, F.col("vec")).alias("vec"))
    rows = scratch.write(keyed)
    # numbers for distinct vectors hold from where they are written
    nodes = scratch.write(rows.where("key is not null").groupBy("key").agg(F.first("kind").alias("kind"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    edges = None
    for k in range(TRIES):
        more = seeds(nodes, k * orders, orders)
        edges = more if edges is None else edges.unionByName(more).groupBy("u", "v").agg(F.max("sim").alias("sim"))
        edges = descend(scratch.write(edges), nodes, scratch)
        found = scratch.write(components(edges.where(F.col("sim") >= LINK).select(F.col("u").alias("a"), F.col("v").alias("b")), scratch))
        if (recall := audit(nodes, found)) >= RECALL:
            break
    if recall < LEAST:
        raise RuntimeError(f"{TRIES * orders} orders found {recall:.3f} of the audited links, less than {LEAST}")
    linked = enlarge(nodes, found, scratch)
    known = nodes.select("key", "node", "copies", "least").join(found, "node", "left").join(linked, "node", "left")
    known = known.select("key", F.coalesce("component", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "least")
    known = scratch.write(known)
    ids = scratch.write(known.groupBy("root").agg(F.min("least").alias("component_id")))  # apart, so that a hot root's rows can be split
    classes = known.join(ids, "root").select("key", "n_links", "component_id")
    out = rows.select("id", "key").join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))
