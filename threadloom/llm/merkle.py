"""A Merkle manifest of a dataset: digests of rows, of sources and of the whole, with proofs.

The nodes of a level stand in an order, in each group for itself. Aligned blocks of ``fanout **
depth`` nodes are taken apart from each other, one row a block, which keeps a level as one string of
digests of fixed width. Substrings of ``fanout`` digests are hashed into the level above; the parts
of such a substring to the left and right of a node are its siblings. What a block ends in is a node
of the next step, whose blocks are worked on in the same way, until each group has one node. The
groups' last nodes, in order, are one more group. Then the way goes down again: a block hands the
path from its end to the root to its nodes.

A node's place decides its block, so blocks hold few rows whatever the size of a group, and no join
or aggregate has a key that many rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ordered import ordered
from threadloom.storage import materialize

WIDTH = 64  # hex digits of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, columns)), 256)


def _parents(level: Column, fanout: int) -> Column:
    """The level above, as one string."""
    run = fanout * WIDTH
    starts = F.sequence(F.lit(1), F.length(level), F.lit(run))
    return F.array_join(F.transform(starts, lambda at: F.sha2(F.substr(level, at, F.lit(run)), 256)), "")


def _siblings(level: Column, place: Column, fanout: int) -> Column:
    """What stands left and right of a place in its run."""
    begin = place - place % fanout
    left = F.substr(level, begin * WIDTH + 1, (place - begin) * WIDTH)
    right = F.substr(level, (place + 1) * WIDTH + 1, (begin + fanout - 1 - place) * WIDTH)
    return F.struct(left.alias("l"), right.alias("r"))


def _blocks(nodes: DataFrame, fanout: int, depth: int, keep: list[str]) -> DataFrame:
    """(group, block, levels, rows, end) of nodes (group, place, digest, *keep).

    A group's first block ends as soon as one node is left, others have ``depth`` levels above:
    there the group goes on.
    """
    size = fanout ** depth
    block = F.floor(F.col("place") / size).cast("long")
    row = F.struct((F.col("place") % size).cast("int").alias("at"), "digest", *keep)
    rows = (nodes.groupBy("group", block.alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
            .withColumn("levels", F.array(F.array_join(F.col("rows.digest"), ""))))
    for _ in range(depth):
        top = F.element_at("levels", -1)
        more = (F.col("block") > 0) | (F.length(top) > WIDTH)
        rows = rows.withColumn("levels", F.when(more, F.array_append("levels", _parents(top, fanout))).otherwise(F.col("levels")))
    return rows.withColumn("end", F.element_at("levels", -1))


def _steps(nodes: DataFrame, fanout: int, depth: int, keep: list[str]) -> list[DataFrame]:
    """Blocks of each step, the last one having one block a group."""
    steps = [materialize(_blocks(nodes, fanout, depth, keep), "merkle-blocks")]
    while not steps[-1].filter("block > 0").isEmpty():
        above = steps[-1].select("group", F.col("block").alias("place"), F.col("end").alias("digest"))
        steps.append(materialize(_blocks(above, fanout, depth, []), "merkle-blocks"))
    return steps


def _down(blocks: DataFrame, paths: DataFrame, fanout: int) -> DataFrame:
    """One row a node of ``blocks``, with ``path``: its siblings, level by level, from ``paths``
    (group, block, path, subroot) of the blocks' ends."""
    every = blocks.join(paths, ["group", "block"])
    rows = every.withColumn("node", F.explode("rows"))
    rise = F.sequence(F.lit(1), F.size("levels") - 1)
    own = F.transform(
        F.when(F.size("levels") > 1, rise).otherwise(F.array().cast("array<int>")),
        lambda k: _siblings(F.element_at("levels", k), F.floor(F.col("node.at") / F.pow(F.lit(fanout), k - 1)).cast("int"), fanout))
    return rows.withColumn("path", F.concat(own, "path")).drop("levels", "rows", "end")


def _descend(steps: list[DataFrame], tops: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Nodes of the first step, from ``tops`` (group, path, subroot) of the groups' last nodes."""
    size = fanout ** depth
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in steps[:0:-1]:
        below = _down(blocks, paths, fanout)
        paths = materialize(below.select("group", (F.col("block") * size + F.col("node.at")).alias("block"), "path", "subroot"), "merkle-paths")
    return _down(steps[0], paths, fanout)


def folded(digest: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, digest, lambda a, s: F.sha2(F.concat(s["l"], a, s["r"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id",
             text_col: str = "text", fanout: int = 3, depth: int = 5, chunk_rows: int = 20_000) -> DataFrame:
    """(id_col, leaf, subroot, root, path, checked, folded_root, verified) of every row.

    ``path`` holds the siblings left and right of the row's node at each level, through its group's
    root to the root. ``checked`` is the leaf computed anew with ``tampered`` in place of the text
    (the leaf itself without it, or where it is null); ``verified`` says whether it leads to the root.

    Leaves ascend by id in their group, groups by name, null first in both. Rows of one id stand in
    the order of their leaves, equal rows in any. Null fields and empty texts differ. A row alone in its
    group is the group's root, and a group alone the root. An empty table gives no rows. Other columns
    are not read.
    """
    known = [F.col(c) for c in fields]
    again = [F.coalesce(tampered, F.col(c)) if c == text_col else F.col(c) for c in fields] if tampered is not None else known
    changed = F.lit(False) if tampered is None else F.coalesce(tampered != F.col(text_col), F.lit(False))
    leaves = docs.select(
        F.col(group_col).isNotNull().alias("named"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("name"), F.col(id_col).alias("id"),
        leaf_digest(known).alias("digest"), F.when(changed, leaf_digest(again)).alias("other"), F.monotonically_increasing_id().alias("tie"))
    # Written: the number that parts equal rows must not change any more.
    leaves = materialize(leaves, "leaves").withColumns({"has_id": F.col("id").isNotNull(), "known_id": F.coalesce("id", F.lit(0))})
    total = leaves.count()
    placed = ordered(leaves, ["named", "name"], ["has_id", "known_id", "digest", "tie"], chunk_rows, (total, total)).with_position("place").plain()
    group = F.struct("named", "name")
    steps = _steps(placed.select(group.alias("group"), "place", "digest", "id", "other"), fanout, depth, ["id", "other"])
    ends = steps[-1].select("group", F.col("end").alias("digest"))
    # All groups are one group, in the order of their names.
    one = ends.select(F.lit(0).alias("all"), "group.named", "group.name", "digest")
    groups = one.count()
    one = ordered(one, ["all"], ["named", "name"], chunk_rows, (groups, groups)).with_position("place").plain()
    above = _steps(one.select(F.lit(0).alias("group"), "place", "digest", group.alias("of")), fanout, depth, ["of"])
    top = above[-1].select("end").first()
    root = top["end"] if top else None
    start = above[-1].select("group", F.expr(f"cast(array() as {PATH})").alias("path"), F.lit(root).alias("subroot"))
    tops = _descend(above, start, fanout, depth).select(F.col("node.of").alias("group"), "path", F.col("node.digest").alias("subroot"))
    found = _descend(steps, materialize(tops, "merkle-paths"), fanout, depth)
    checked = F.coalesce("node.other", "node.digest")
    found = found.select(F.col("node.id").alias(id_col), F.col("node.digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", checked.alias("checked"))
    return (found.withColumn("folded_root", folded(F.col("checked"), F.col("path")))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def proof_text(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")
