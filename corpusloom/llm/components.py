"""Connected components by hooking and shortcutting over parent tables.

Every root that has an edge to a smaller root is hooked to the smallest such root; then every parent is replaced by
its parent's parent until all trees are stars.  Edges are rewritten to the roots and shrink from round to round.
At least half of the roots that still have an edge vanish in a round, so rounds grow with the logarithm of the
vertices.  Nothing is gathered: each step is a join or a grouped minimum of tables written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _shortcut(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """Pointer doubling until each vertex points at its root."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("g"))
        new = scratch.table(parents.join(up.hint("merge"), "p", "left").select("v", F.coalesce("g", "p").alias("p"), (F.coalesce("g", "p") != F.col("p")).alias("moved")), "jump")
        scratch.drop(parents)
        moved = new.where("moved").limit(1).count()
        parents = new.select("v", "p")
        parents._scratch_path = new._scratch_path
        if not moved:
            return parents


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex that has an edge; *edges* has columns a and b of one orderable type.

    root is the smallest vertex of the component.  Edges may repeat and may be loops; those with a null end are
    ignored.  An empty table gives an empty result.
    """
    live = scratch.table(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    vertices = live.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    parents = None
    while True:
        links = live.where("a <> b")
        if parents is not None and not links.limit(1).count():
            scratch.drop(live)
            return parents.select("v", F.col("p").alias("root"))
        hooks = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        if parents is None:
            parents = scratch.table(vertices.join(hooks.hint("merge"), "v", "left").select("v", F.coalesce("p", "v").alias("p")), "parents")
        else:
            new = scratch.table(parents.join(hooks.select(F.col("p").alias("h"), F.col("v").alias("p")).hint("merge"), "p", "left").select("v", F.coalesce("h", "p").alias("p")), "parents")
            scratch.drop(parents)
            parents = new
        parents = _shortcut(scratch, parents)
        up = parents.select(F.col("v"), F.col("p"))
        new = scratch.table(
            links.join(up.withColumnsRenamed({"v": "a", "p": "ra"}).hint("merge"), "a").join(up.withColumnsRenamed({"v": "b", "p": "rb"}).hint("merge"), "b")
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        scratch.drop(live)
        live = new
