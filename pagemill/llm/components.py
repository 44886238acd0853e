"""Connected components by label propagation over tables; no edges at the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import written


def forest(edges: DataFrame) -> DataFrame:
    """a, b: the edges of each partition as stars around the smallest node of each of its components.

    Union-find over the distinct nodes of a partition; edges inside a partition's components go.
    """

    def contract(batches):
        root: dict[int, int] = {}

        def find(x):
            while (p := root.setdefault(x, x)) != x:
                root[x] = root[p]
                x = p
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in list(root)]
        rows = [r for r in rows if r[0] != r[1]]
        for i in range(0, len(rows), 100_000):
            part = np.array(rows[i : i + 100_000], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches), for every node with an edge (a, b longs).

    Each round, a node takes the smallest label among its neighbours, then its label's label; what
    has settled is not joined again once labels of both ends agree.
    """
    edges = written(forest(edges).distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        open_ = written(edges.join(of_b, "b").join(of_a, "a").where("ca <> cb").select("ca", "cb"), "open-edges")
        if not open_.head(1):
            return labels
        # edges between labels: hook the larger label to the smallest one it meets, and follow the chain
        stars = open_.select(F.greatest("ca", "cb").alias("component"), F.least("ca", "cb").alias("to")).groupBy("component").agg(F.min("to").alias("to"))
        stars = written(stars, "hooks")
        for _ in range(2):
            further = stars.select(F.col("component").alias("to"), F.col("to").alias("next"))
            stars = written(stars.join(further, "to", "left").select("component", F.coalesce("next", "to").alias("to")), "hooks")
        labels = written(labels.join(stars, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
