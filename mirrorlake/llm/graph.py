"""Block pairs of groups: no group of any size meets in one task. Components are the library's."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.operators.components import components

__all__ = ["block_pairs", "components", "stars"]


def block_pairs(rows: DataFrame, group: str, n: str, node: str, most: int) -> DataFrame:
    """Deal the rows of each group (n: its size) into blocks of about most rows, and give a row for each
    pair of blocks that it takes part in: columns x and y (blocks, x <= y) and mine (the row's own).
    All pairs of a group meet once and no pair of blocks holds more than about twice most rows."""
    rows = rows.withColumn("blocks", F.ceil(F.col(n) / F.lit(most)).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(node, group), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    return rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("other", "blocks")


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n nodes under links a-b: the least node that it reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != (more := new[new])).any():
            new = more
        if (new == root).all():
            return root
        root = new
