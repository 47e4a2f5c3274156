"""A Merkle tree over a dataset, with proofs.

Leaves are digests of rows. Per group (source) they stand in order and every 16 consecutive nodes have a parent, until
one is left, the subroot; the subroots, in order of their groups, are the leaves of the crown, whose top is the root.

*Order.* Leaves are range-partitioned by (group, order), numbered within (partition, group), and moved up by what the
partitions before hold of their group: a sum over (partition, group) counts. No group is ever in one task.

*Combining.* The tree grows by events, as a ``combineByKey`` whose key is the parent: a task keeps partial parents, each
with the child digests that have come, by place. A parent's arity follows from the size of its level, so once it has all
its children it is hashed and is itself an event for its own parent; a task so emits whole ancestors. What is partial at
a task's end, at most a few children a level where groups are cut by partitions, is the frontier: it is shuffled by parent
and combined anew, until only tops are left. Each round completes at least the lowest open level.

*Proofs.* Each node keeps its children (the reverse link). From the top down every node gets the siblings on its way to
the root, as (left, right) pairs; only parents of leaves are joined with leaves, so proofs are never shuffled leaf by leaf.

Every round's nodes are a table in the shared folder, so a lost executor costs single tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import discard, materialize

ARITY = 16
#: Children of the frontier that one task combines.
FRONTIER = 16384

_NODES = "kind string, grp string, level int, idx long, digest string, n long, children array<string>"


def encoded(*columns: str, **values: Column) -> Column:
    """Columns (or the ``values`` given for them) as one text: ``-`` for a null, else the number of its UTF-8 bytes, ``:``
    and the value."""
    out = []
    for c in columns:
        value = values.get(c, F.col(c)).cast("string")
        out.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.concat(*out)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def width(n: int, level: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves (grp, order columns, digest, more) with ``idx``, the place in their group, and ``n``, the group's size.
    Ties of the order go by digest; rows that are equal in all are numbered as they come."""
    order = [c for c in leaves.columns if c.startswith("order")] + ["digest"]
    cut = leaves.withColumn("_row", F.monotonically_increasing_id())
    cut = materialize(cut.repartitionByRange("grp", *order, "_row").withColumn("part", F.spark_partition_id()))
    held = cut.groupBy("grp", "part").agg(F.count("*").alias("_n"))
    group = W.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select("grp", "part", before.alias("_before"), F.sum("_n").over(group).alias("n"))
    own = F.row_number().over(W.partitionBy("grp", "part").orderBy(*order, "_row"))
    out = materialize(cut.withColumn("_own", own).join(held, ["grp", "part"]).withColumn("idx", F.col("_before") + F.col("_own") - 1).drop("_before", "_own", "_row", "part"))
    discard(cut)
    return out


def _combine(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Events (grp, level, idx, digest, n) to whole nodes with their children, tops, and the open frontier."""
    partial: dict = {}
    out: list[dict] = []

    def event(grp, level, idx, sha, n) -> None:
        while (here := width(n, level)) > 1:
            key = (grp, level + 1, idx // ARITY)
            children = partial.setdefault(key, {})
            children[idx % ARITY] = (sha, n)
            if len(children) < min(ARITY, here - idx // ARITY * ARITY):
                return
            hashes = [children[i][0] for i in range(len(children))]
            sha = hashlib.sha256("".join(hashes).encode()).hexdigest()
            del partial[key]
            grp, level, idx = key
            out.append({"kind": "node", "grp": grp, "level": level, "idx": idx, "digest": sha, "n": n, "children": hashes})
        out.append({"kind": "top", "grp": grp, "level": level, "idx": 0, "digest": sha, "n": n})

    for batch in batches:
        for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "level", "idx", "digest", "n"))):
            event(*r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    for (grp, level, idx), children in partial.items():
        out += [{"kind": "open", "grp": grp, "level": level - 1, "idx": idx * ARITY + i, "digest": sha, "n": n} for i, (sha, n) in children.items()]
        if len(out) > FRONTIER:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def grown(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their children, tops) of the trees over leaves (grp, idx, digest, n)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(leaves.sparkSession.createDataFrame([], _NODES).schema)
    combine = lambda batches: _combine(batches, schema)
    events = leaves.select("grp", F.lit(0).alias("level"), "idx", "digest", "n")
    rounds, left = [], None
    while left is None or left:
        rounds.append(materialize(events.mapInArrow(combine, _NODES)))
        frontier = rounds[-1].where("kind = 'open'")
        left = frontier.count()
        parent = F.expr(f"idx div {ARITY}")
        events = frontier.select("grp", "level", "idx", "digest", "n").repartition(-(-left // FRONTIER) or 1, "grp", "level", parent).sortWithinPartitions("level", "grp", "idx")
    rows = rounds[0]
    for more in rounds[1:]:
        rows = rows.unionAll(more)
    return rows.where("kind = 'node'"), rows.where("kind = 'top'").select("grp", "digest")


def _sides(children: str, at: str) -> Column:
    """(left, right): the joined digests of the children on either side of a place (from 0)."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), F.col(at)), "").alias("left"), F.array_join(F.slice(children, F.col(at) + 2, F.lit(ARITY)), "").alias("right"))


def paths(leaves: DataFrame, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``leaves`` (grp, idx, n, more) with ``up``: the (left, right) siblings on each level up to the top, followed by the
    ``up`` of their group in ``above`` (grp, up, subroot), and with its ``subroot`` (null without ``above``). Both come
    down from the tops, so no group is a join key of all its leaves."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    depth = nodes.agg(F.max("level")).first()[0] or 0

    def crowned(df: DataFrame) -> DataFrame:
        return df.withColumns({"up": none, "subroot": F.lit(None).cast("string")}) if above is None else df.join(above, "grp")

    def below(df: DataFrame, parents: DataFrame) -> DataFrame:
        df = df.withColumns({"_at": (F.col("idx") % ARITY).cast("int"), "_parent": F.expr(f"idx div {ARITY}")})
        own = parents.select("grp", F.col("idx").alias("_parent"), F.col("children").alias("_all"), "up", "subroot")
        return df.join(own, ["grp", "_parent"]).withColumn("up", F.concat(F.array(_sides("_all", "_at")), F.col("up"))).drop("_at", "_parent", "_all")

    parents = None
    for level in range(depth, 0, -1):
        here = nodes.where(F.col("level") == level).select("grp", "idx", "n", "children")
        tops = crowned(here.where(F.col("n") <= ARITY**level))
        parents = tops if parents is None else tops.unionByName(below(here.where(F.col("n") > ARITY**level), parents))
    alone = crowned(leaves.where("n = 1"))
    return alone if parents is None else below(leaves.where("n > 1"), parents).unionByName(alone)


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(way, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def proof(way: Column) -> Column:
    """The siblings of all levels as one text, left to right, level by level."""
    return F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), "")


def build(rows: DataFrame, group: str, order: str, leaf: Column, *more: Column) -> DataFrame:
    """(``order``, ``more``, leaf, subroot, root, way): the manifest of ``rows``, one row each.

    ``leaf`` is a row's digest. Groups stand null first, then bytewise; leaves by ``order``, nulls first, ties by digest,
    so repeated rows are neighbours and have a place each. An empty table gives an empty one. ``way`` is an array of
    (left, right) sibling digests from the leaf to the root; see ``folded`` and ``proof``.
    """
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    raw = materialize(rows.select(key.alias("grp"), F.col(order).alias("order"), leaf.alias("digest"), *more))
    leaves = numbered(raw)
    discard(raw)
    nodes, tops = grown(leaves)
    subroots = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("order"), "digest"))
    crown, root = grown(subroots)
    top = root.first()
    above = paths(subroots, crown).select(F.col("order").alias("grp"), "up", F.col("digest").alias("subroot"))
    found = paths(leaves, nodes, above).withColumn("root", F.lit(top.digest if top else None).cast("string"))
    return found.withColumnsRenamed({"digest": "leaf", "order": order, "up": "way"}).drop("grp", "idx", "n")
