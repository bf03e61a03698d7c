"""The best few (score, id) of many groups: kept in a task, merged over tasks.

Higher scores come first, equal scores by smaller id. An id of ``NO_ID`` stands for a
missing one and comes last.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_ID = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min

#: What a task hands on: one row for each group it has something of.
TYPE = "group_no int, ids array<bigint>, scores array<bigint>"


class Best:
    """At most ``k`` entries for each of ``groups`` groups."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        #: scores below this can't enter a group any more
        self.floor = np.full(groups, _LEAST, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take entries in; several groups may come in any order."""
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, group))
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        kept = order[nth < self.k]
        self.group, self.score, self.id = group[nth < self.k], score[kept], ids[kept]
        full = nth == self.k - 1
        self.floor[group[full]] = score[order[full]]

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if len(self.group) else np.empty(0, np.int64)
        ends = pa.array(np.r_[at, len(self.group)].astype(np.int32))
        ids = pa.array(self.id, mask=self.id == NO_ID)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.group[at].astype(np.int32)), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(self.score))],
            ["group_no", "ids", "scores"],
        )


def merged(rows: DataFrame, k: int, salt: int = 1) -> DataFrame:
    """The ``k`` best of each group over all tasks: (group_no, nth, id, score).

    Where a few groups get entries from many tasks, ``salt`` parts of each are cut to
    ``k`` on their own first; the rank filter also runs before each shuffle.
    """
    each = rows.select("group_no", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "group_no", F.col("x.ids").alias("id"), F.col("x.scores").alias("score")
    )

    def cut(df: DataFrame, keys: Sequence) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)

    if salt > 1:
        each = cut(each, ["group_no", F.pmod(F.xxhash64("id", "score"), F.lit(salt))]).drop("nth")
    return cut(each, ["group_no"]).select("group_no", "nth", "id", "score")
