"""Connected components of a link table, without any part of it on the driver.

Alternating large-star and small-star rounds: each round is two grouped minima and joins on shuffled keys, and is cut
off from its lineage by a table in the shared folder. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapframe.llm.common import drop_written, spread_join, written


def _star(links: DataFrame, both: bool, total: int) -> DataFrame:
    """Large-star (``both``: larger neighbours move to the smallest) or small-star (smaller neighbours and the node do).

    A hub has a row a neighbour; its rows are dealt to several tasks.
    """
    forth = links.select("u", "v")
    near = forth.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else forth.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = near.where("v > u") if both else near
    out = spread_join(moved, least.drop("n"), ["u"], least.select("u", "n"), total, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, among: list[DataFrame] | None = None) -> DataFrame:
    """``links(u, v)`` (long) to ``(node, root)``, root being the smallest node reached; only linked nodes have a row. The
    table that the result reads is added to ``among``, if given."""
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, total = None, links.count()
    while True:
        larger = written(_star(links, True, 2 * total), "links")
        drop_written(links)
        links = written(_star(larger, False, total), "links")
        drop_written(larger)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            if among is not None:
                among.append(links)
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, total = state, state[0]


def local_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels (smallest position of the component) of ``n`` nodes under links ``a - b``, continuing ``labels``."""
    labels = np.arange(n) if labels is None else labels
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
