"""Connected components by contraction, for links that only the cluster can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.session import discard, stage


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs): equal roots, one component.

    Every round points each node at the member of its neighbourhood, itself
    included, with the least hash of that round, and contracts the links along
    those pointers; the random order makes the links shrink by a constant factor
    in expectation, whatever the shape of a component. No task gathers a
    component: a round is one aggregation, which combines before its shuffle,
    and joins of written tables. Links to oneself are allowed; a null end makes
    a row no link.
    """
    links = links.filter("a is not null and b is not null").select("a", "b")
    label = stage(
        links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")),
        "component-labels",
    )
    edges = stage(links.filter("a <> b").distinct(), "component-links")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("to"))
        a, b = F.col("a"), F.col("b")
        least = edges.select(
            F.explode(F.array(*(F.struct(x.alias("of"), F.least(order(a), order(b)).alias("best")) for x in (a, b)))).alias("e")
        )
        points = stage(
            least.groupBy(F.col("e.of").alias("of")).agg(F.min("e.best")["to"].alias("to")), "component-points"
        )
        pa, pb = (points.select(F.col("of").alias(f"{x}_of"), F.col("to").alias(f"{x}_to")) for x in "ab")
        moved = edges.join(pa, edges["a"] == pa["a_of"]).join(pb, edges["b"] == pb["b_of"])
        low, high = F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")
        label, old_label = stage(
            label.join(points, label["root"] == points["of"], "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "component-labels",
        ), label
        edges, old_edges = stage(moved.select(low, high).filter("a <> b").distinct(), "component-links"), edges
        discard(old_label, old_edges, points)
    discard(edges)
    return label
