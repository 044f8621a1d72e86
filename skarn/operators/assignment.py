"""Globally best assignment of scored pairs, where staying unmatched is an option.

Pairs form a bipartite graph; its connected components are independent and each is solved by shortest augmenting paths over its
own pairs, in a group of its own: memory grows with the pairs, never with sources times targets. A pair is only taken if it beats leaving both of
its ends unmatched, which counts ``baseline`` together.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.components import connected_components


def least_cost(edges: list[dict[int, float]]) -> list[int]:
    """The column of each row so that the sum of costs is least; -1 - k is row k's own stand-in, which costs nothing.

    ``edges``: the cost of each column that a row may take. Rows enter one by one. For each, distances by reduced cost grow over the
    alternating paths until a column without a row is reached; the path to it is then flipped.
    """
    row_price = [0.0] * len(edges)
    column_price: dict[int, float] = {}
    column_of, row_of = [0] * len(edges), {}
    for start in range(len(edges)):
        distance: dict[int, float] = {}
        before: dict[int, int] = {}
        done: dict[int, float] = {}  # columns in the order in which they were reached
        queue: list[tuple[float, int]] = []
        row, reached = start, 0.0
        while True:
            base = reached - row_price[row]
            for column, cost in (*edges[row].items(), (-1 - row, 0.0)):
                if column in done:
                    continue
                through = base + cost - column_price.get(column, 0.0)
                if through < distance.get(column, float("inf")):
                    distance[column], before[column] = through, row
                    heapq.heappush(queue, (through, column))
            reached, column = heapq.heappop(queue)
            while column in done:
                reached, column = heapq.heappop(queue)
            if column not in row_of:
                break
            done[column] = reached
            row = row_of[column]
        row_price[start] += reached
        for near, there in done.items():
            row_price[row_of[near]] += reached - there
            column_price[near] = column_price.get(near, 0.0) - (reached - there)
        while True:
            row = before[column]
            row_of[column] = row
            column_of[row], column = column, column_of[row]
            if row == start:
                break
    return column_of


def assign_component(edges: pd.DataFrame, baseline: float) -> pd.DataFrame:
    """The pairs taken of one component: source_id, target_id, score."""
    best = edges.groupby(["source_id", "target_id"], sort=True, as_index=False)["score"].max()
    best = best[best["score"] > baseline]
    sources, source_names = pd.factorize(best["source_id"])
    targets, target_names = pd.factorize(best["target_id"])
    scores: list[dict[int, float]] = [{} for _ in source_names]
    for s, t, score in zip(sources.tolist(), targets.tolist(), best["score"].tolist(), strict=True):
        scores[s][t] = score
    taken = least_cost([{t: baseline - score for t, score in own.items()} for own in scores])
    return pd.DataFrame(
        [(source_names[s], target_names[t], scores[s][t]) for s, t in enumerate(taken) if t >= 0], columns=["source_id", "target_id", "score"]
    )


def assign(edges: DataFrame, baseline: float = 0.45) -> DataFrame:
    """source_id, target_id, score of the assignment of most weight over all components.

    Pairs that do not beat ``baseline`` are never taken, and so link no components; only ids and scores go to a component's task.
    """
    kinds = dict(edges.dtypes)
    edges = edges.where(F.col("score") > baseline)
    nodes = edges.select(
        F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("src"), F.concat(F.lit("t"), F.col("target_id").cast("string")).alias("dst"),
        "source_id", "target_id", "score",
    )
    groups = connected_components(nodes).select(F.col("node").alias("src"), "component")
    return nodes.join(groups, "src").select("component", "source_id", "target_id", "score").groupBy("component").applyInPandas(
        lambda group: assign_component(group[["source_id", "target_id", "score"]], baseline), f"source_id {kinds['source_id']}, target_id {kinds['target_id']}, score double"
    )
