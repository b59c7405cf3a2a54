"""References to records that do not exist: direct orphans and those that inherit them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import written

#: Rounds after which the finds of all rounds become one table, so that plans of deep graphs stay small.
GATHER = 16


@dataclass
class Edge:
    """Foreign key ``child.child_cols -> parent.parent_cols``.

    ``valid_from`` (inclusive) and ``valid_to`` (exclusive, null: open) name parent columns that bound
    the days on which a parent row answers; ``child_day`` names the child's day. All columns must
    already be in comparable form.
    """

    child: str
    child_cols: list[str]
    parent: str
    parent_cols: list[str]
    child_day: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None
    name: str = field(default="")


def _match(edge: Edge, child: DataFrame, parent: DataFrame) -> tuple[DataFrame, Column]:
    """The parent side reduced to what the join needs, and the join condition."""
    p = parent.select(
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(edge.parent_cols)],
        *([F.col(edge.valid_from).alias("_from")] if edge.valid_from else []),
        *([F.col(edge.valid_to).alias("_to")] if edge.valid_to else []),
    ).distinct()
    on = reduce(lambda a, b: a & b, [child[c] == p[f"_p{i}"] for i, c in enumerate(edge.child_cols)])
    if edge.child_day and edge.valid_from:
        on &= p["_from"].isNull() | (child[edge.child_day] >= p["_from"])
    if edge.child_day and edge.valid_to:
        on &= p["_to"].isNull() | (child[edge.child_day] < p["_to"])
    return p, on


def direct_orphans(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """Child rows with a wholly non-null reference that no parent row valid on the child's day answers.

    Defined cases: a null reference is no orphan; a null day finds only parents without bounds; a null
    ``valid_from`` means valid from ever; repeated child rows each come out; an empty parent makes every
    reference an orphan; child columns come out unchanged (the parent's are renamed inside).
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in edge.child_cols])
    child = child.where(present)
    p, on = _match(edge, child, parent)
    return child.join(p, on, "left_anti")


def orphan_cascade(nodes: dict[str, DataFrame], edges: list[Edge], id_col: str = "row_id", max_rounds: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixpoint over the foreign-key graph: ``table_name, <id_col>, edge, kind (direct | inherited), depth`` and the columns ``keep`` of the orphaned rows.

    A row is a *direct* orphan (depth 0) by an edge whose reference nothing answers. It *inherits* when its
    reference is answered by orphaned rows only. Each round semi-joins the children of the newly orphaned
    rows; the loop ends when a round finds none (cycles end because a row is orphaned once). One row per
    (table, id, edge); the smallest depth wins. ``id_col`` must be unique per table. With ``max_rounds``, rows that
    are still found after so many rounds are an error. The columns ``keep`` must be in all tables that refer to others, with equal types; carrying them spares
    a join back to these tables.

    Each round's finds are written to the shared folder, and every ``GATHER`` rounds all finds together, so lineage
    stays short and a lost executor costs one round at most. Only row counts reach the driver.
    """
    schema_cols = ["table_name", id_col, "edge", "kind", "depth", *keep]

    def tag(df: DataFrame, edge: Edge, kind: str, depth: int) -> DataFrame:
        return df.select(
            F.lit(edge.child).alias("table_name"), F.col(id_col).cast("long").alias(id_col),
            F.lit(edge.name or f"{edge.child}->{edge.parent}").alias("edge"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), *keep,
        )

    found = written(
        reduce(DataFrame.unionByName, [tag(direct_orphans(nodes[e.child], nodes[e.parent], e), e, "direct", 0) for e in edges]),
        "orphans",
    )
    for depth in count(1):
        fresh = found.where(F.col("depth") == depth - 1).select("table_name", id_col).distinct()
        parts = []
        for e in edges:
            parent, child = nodes[e.parent], nodes[e.child]
            if id_col not in parent.columns or not any(x.child == e.parent for x in edges):
                continue
            lost = found.where(F.col("table_name") == e.parent).select(F.col(id_col).alias("_lost")).distinct()
            new = fresh.where(F.col("table_name") == e.parent).select(F.col(id_col).alias("_new"))
            reached_by = parent.join(new, parent[id_col] == new["_new"], "left_semi")
            alive = parent.join(lost, parent[id_col] == lost["_lost"], "left_anti")
            present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in e.child_cols])
            p, on = _match(e, child, reached_by)
            reached = child.where(present).join(p, on, "left_semi")
            p, on = _match(e, reached, alive)
            inherited = tag(reached.join(p, on, "left_anti"), e, "inherited", depth)
            parts.append(inherited.join(found.select("table_name", id_col, "edge"), ["table_name", id_col, "edge"], "left_anti").select(schema_cols))
        if not parts:
            break
        step = written(reduce(DataFrame.unionByName, parts), "orphans")
        if step.isEmpty():
            break
        if max_rounds is not None and depth > max_rounds:
            raise ValueError(f"orphans are still inherited after {max_rounds} rounds")
        found = found.unionByName(step)
        if depth % GATHER == 0:
            found = written(found, "orphans")
    return found.select(schema_cols)
