"""Connected components of links between nodes, as a table node -> root with the smallest node of each component as root."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import shared as S

#: Up to this many links one task settles what is left; beyond it, rounds of joins do.
ONE_TASK = 1_000_000


def roots_of(u: list, v: list) -> tuple[list, list]:
    """Union-find over these links: every node, and the smallest node it is connected with."""
    parent: dict = {}

    def find(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(u, v, strict=True):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return list(parent), [find(x) for x in parent]


def _local(batches):
    u, v = [], []
    for batch in batches:
        u += batch.column(0).to_pylist()
        v += batch.column(1).to_pylist()
        if len(u) > 4 * ONE_TASK:  # keep only what these links come to
            u, v = roots_of(u, v)
    nodes, roots = roots_of(u, v)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root for every node of links (u, v: binary or long). Links may repeat, and may link a node with itself."""
    kind = links.schema["u"].dataType.simpleString()
    stars = S.stored(links.select("u", "v").mapInArrow(S.tidy(_local), f"u {kind}, v {kind}").distinct(), "stars")
    while True:
        if stars.count() <= one_task:
            done = stars.coalesce(1).mapInArrow(S.tidy(_local), f"u {kind}, v {kind}")
            return S.stored(done.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
        # large star: what is larger than a node is linked with the node's smallest neighbour; small star: the rest is
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = S.stored(large.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        down = large.filter("v <= u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = S.stored(small, "stars")
        same = small.count()
        if same == stars.count() and small.exceptAll(stars).isEmpty():
            return S.stored(small.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root"), "components")
        stars = small
