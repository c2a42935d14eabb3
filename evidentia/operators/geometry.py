"""Boxes on pages: matching by overlap and clustering by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.vectors import iou

_EDGES = ("xmin", "ymin", "xmax", "ymax")


def match_boxes(left: DataFrame, right: DataFrame, on: list[str], threshold: float = 0.5) -> DataFrame:
    """(on, left_id, right_id, iou): the best overlap of each left box; both sides' others kept.

    Boxes are (on, id, xmin, ymin, xmax, ymax). Only boxes that agree in ``on`` (page, class) meet.
    """
    a = left.select(*on, F.col("id").alias("left_id"), *[F.col(e).alias(f"a_{e}") for e in _EDGES])
    b = right.select(*on, F.col("id").alias("right_id"), *[F.col(e).alias(f"b_{e}") for e in _EDGES])
    met = a.join(b, on).withColumn("iou", F.round(iou("a", "b"), 9)).where(F.col("iou") >= threshold)
    best = met.withColumn("_k", F.row_number().over(Window.partitionBy(*on, "left_id").orderBy(F.desc("iou"), "right_id"))).where("_k = 1").select(*on, "left_id", "right_id", "iou")
    only_a = a.join(best.select(*on, "left_id"), [*on, "left_id"], "left_anti").select(*on, "left_id", F.lit(None).cast(right.schema["id"].dataType).alias("right_id"), F.lit(None).cast("double").alias("iou"))
    only_b = b.join(best.select(*on, "right_id").distinct(), [*on, "right_id"], "left_anti").select(*on, F.lit(None).cast(left.schema["id"].dataType).alias("left_id"), "right_id", F.lit(None).cast("double").alias("iou"))
    return best.unionByName(only_a).unionByName(only_b)


def cluster_boxes(boxes: DataFrame, page: str, tolerance: float) -> DataFrame:
    """(page, xmin, ymin, xmax, ymax, members): boxes joined while their gaps are within tolerance.

    A page holds a bounded number of boxes; its clusters are found by sweeping them in order.
    """
    kind = boxes.schema[page].dataType.simpleString()

    def join(rows: np.ndarray) -> list[tuple]:
        parent = list(range(len(rows)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        open_: list[int] = []
        for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
            open_ = [j for j in open_ if rows[j][2] + tolerance >= rows[i][0]]
            for j in open_:
                if rows[j][1] - tolerance <= rows[i][3] and rows[i][1] - tolerance <= rows[j][3]:
                    parent[root(i)] = root(j)
            open_.append(i)
        groups: dict[int, list[int]] = {}
        for i in range(len(rows)):
            groups.setdefault(root(i), []).append(i)
        return [(*rows[g][:, :2].min(axis=0), *rows[g][:, 2:].max(axis=0), len(g)) for g in groups.values()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, *c) for p, b in zip(pdf[page], pdf["boxes"], strict=True) for c in join(np.array([[x[e] for e in _EDGES] for x in b], float))]
            yield pd.DataFrame(out, columns=[page, *_EDGES, "members"])

    grouped = boxes.groupBy(page).agg(F.collect_list(F.struct(*[F.col(e).cast("double").alias(e) for e in _EDGES])).alias("boxes"))
    return grouped.mapInPandas(run, f"{page} {kind}, xmin double, ymin double, xmax double, ymax double, members int")
