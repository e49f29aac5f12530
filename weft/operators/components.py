"""Connected components by repeated hooking and pointer jumping.

Every round hooks each node to its smallest smaller neighbour, shortens the
resulting trees to stars by pointer jumping and contracts the edges onto the
roots. Only joins (which Spark can split on a hot key) and ``min`` aggregates
(which combine on the map side) are used, so one hub does not become one task.
Each round's tables are written to the shared folder: nothing is collected but
row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialize, release


def _follow(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: (node, root) with each root followed to the end of its chain."""
    while True:
        up = hooks.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        joined = hooks.join(up, hooks.root == up.mid, "left").select(
            "node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")
        )
        step = materialize(joined)
        release(hooks)
        moved = step.where("moved").limit(1).count()
        hooks = step.select("node", "root")
        hooks._weft_path = step._weft_path
        if not moved:
            return hooks


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, root): the smallest node of each node's component.

    Nodes that are the smallest of their component, or have no edge, are absent:
    they are their own root. Self loops, repeated and NULL-ended edges are ignored;
    an empty edge table gives an empty result.
    """
    live = materialize(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .where((F.col(src).isNotNull()) & (F.col(dst).isNotNull()) & (F.col(src) != F.col(dst)))
        .distinct()
    )
    labels = None
    while live.limit(1).count():
        hooks = _follow(materialize(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))))
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            merged = materialize(
                labels.join(up, labels.root == up.mid, "left")
                .select("node", F.coalesce("top", "root").alias("root"))
                .unionByName(hooks)
            )
            release(labels)
            labels = merged
        at_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = (
            live.join(at_a, "a", "left")
            .join(at_b, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        rest = materialize(contracted)
        release(live)
        if labels is not hooks:
            release(hooks)
        live = rest
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
