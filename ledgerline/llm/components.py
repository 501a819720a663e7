"""Connected components of a table of links, by distributed union-find: hook every node to its smallest neighbour,
halve the paths, and go on with the links between the roots that are left. DataFrame operations only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, root): the smallest node that each linked node can reach.

    Every round's links are a stored table. A node with very many links is no hot group: its links are reduced to
    their minimum before they meet. A component of n nodes needs about log2(n) rounds at most, as each root
    that still has a link joins a smaller one. Loops (a = b), nulls and repeated links are ignored.
    """
    left = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    found = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        hooks = materialize(
            both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), "hooks"
        )
        for _ in range(2):  # root of the root
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hooks = hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        hooks = materialize(hooks, "hooks")
        found = hooks if found is None else materialize(_follow(found, hooks), "found")
        one = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialize(
            left.join(one, "a").join(two, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links",
        )
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _follow(found: DataFrame, hooks: DataFrame) -> DataFrame:
    """Nodes found so far with the new roots of their roots."""
    up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return found.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
