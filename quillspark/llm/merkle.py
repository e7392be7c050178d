"""A dataset's manifest as a Merkle tree: a subtree for each source, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import remove, written
from quillspark.llm.ranks import numbered

#: How many consecutive nodes become one.
RUN = 16
#: What a leaf is made of, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A step of a proof: the digests of a run that stand before a node and those after it, joined.
STEPS = "array<struct<before: string, after: string>>"
#: Rows are joined with their source by pieces of so many consecutive places, so that no source is one key.
PIECE = 1024


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""

    def spelled(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*(spelled(c.cast("string")) for c in fields)), 256)


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps give."""
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """The digests of a proof, level by level from the leaf up, joined."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, leaf, ..) with subroot, root and ``steps``, each row's proof: at every level the
    digests before and after its node in the node's run, from the leaf up.

    A source's leaves ascend by doc_id, null first, and then by leaf; rows that repeat are leaves of their own. Sources ascend
    as bytes, the null one first, which isn't the empty one. A source of one row has its leaf as subroot, a single source its subroot
    as root; no rows give no rows. Other columns pass through, whatever their names unless they start with ``_``.

    Levels are built bottom-up and written to the shared folder; a run has at most 16 nodes, so a source with most of the rows
    is spread like any other. Proofs are pushed top-down: a level joins its parents, and each child puts its siblings before
    the steps that it inherits. Parents of leaves are a 16th of the rows, and the leaves' own proofs are never shuffled.
    """
    base = _placed(rows)
    size = base.groupBy("_source").agg(F.max("_n").alias("n")).agg(F.max("n"), F.count("*")).first()
    levels, subroots = _built(base.select(F.col("_source").alias("_tree"), "_place", "_n", F.col("leaf").alias("_digest")), size[0] or 0)
    tops, roots = _built(subroots.select(F.lit(0).cast("bigint").alias("_tree"), F.col("_tree").alias("_place"), F.lit(size[1]).alias("_n"), "_digest"), size[1])
    proven = _pushed(tops[0], tops, roots.select("_tree", F.col("_digest").alias("_root"), F.array().cast(STEPS).alias("_steps")))
    ends = proven.select(F.col("_place").alias("_tree"), F.col("_digest").alias("_subroot"), "_root", "_steps")
    done = _pushed(base.withColumn("_tree", F.col("_source")), levels, ends)
    return done.select(*(done[c] for c in rows.columns), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_steps").alias("steps"))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their source, their place in it and its size: _source, _place, _n.

    All rows are numbered by source first; pieces of consecutive places then tell where each source starts.
    """
    spark = rows.sparkSession
    known, known_path = written(rows)
    every, every_path = written(numbered(known, "source", "doc_id", "leaf", at="_at").withColumn("_piece", F.floor(F.col("_at") / PIECE)))
    remove(spark, known_path)
    name = F.struct(F.col("source").isNotNull(), F.coalesce("source", F.lit("")))
    pieces, _ = written(every.groupBy(name.alias("_name"), "_piece").agg(F.min("_at").alias("first"), F.count("*").alias("n")))
    sources, _ = written(pieces.groupBy("_name").agg(F.min("first").alias("_start"), F.sum("n").alias("_n")))
    found = pieces.select("_name", "_piece").join(numbered(sources, "_start", at="_source"), "_name")
    placed = every.withColumn("_name", name).join(found, ["_name", "_piece"]).withColumn("_place", F.col("_at") - F.col("_start"))
    out, _ = written(placed.select(*rows.columns, "_source", "_place", "_n"))
    remove(spark, every_path)
    return out


def _built(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels over ``nodes`` (_tree, _place, _n, _digest; ``_n`` nodes to a tree, ``most`` at most), from the nodes up,
    and the roots of all trees, at whatever level each ends. Levels above the first have ``_kids`` and are written."""
    levels, roots = [nodes], nodes.filter("_n = 1").select("_tree", "_digest")
    while most > 1:
        most = -(-most // RUN)
        runs = levels[-1].filter("_n > 1").groupBy("_tree", F.floor(F.col("_place") / RUN).alias("_place"), F.ceil(F.col("_n") / RUN).alias("_n"))
        kids = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_digest"))), lambda k: k["_digest"]).alias("_kids"))
        level, _ = written(kids.withColumn("_digest", F.sha2(F.array_join("_kids", ""), 256)))
        levels.append(level)
        roots = roots.unionByName(level.filter("_n = 1").select("_tree", "_digest"))
    return levels, roots


def _pushed(nodes: DataFrame, levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``nodes``, the lowest of ``levels``, each with its steps up to the root of its tree and on with those in ``ends`` (_tree, _steps, ..)."""
    above = None
    for level in reversed(levels[1:]):
        above, _ = written(_inherited(level, above, ends))
    return _inherited(nodes, above, ends)


def _inherited(level: DataFrame, above: DataFrame | None, ends: DataFrame) -> DataFrame:
    """``level`` with what ``ends`` has for its roots, and with the steps of the parents in ``above`` behind their own for the others."""
    carried = [c for c in ends.columns if c not in ("_tree", "_steps")]
    roots = level.filter("_n = 1").join(ends, "_tree")
    if above is None:
        return roots
    parents = above.select("_tree", F.col("_place").alias("_parent"), F.col("_kids").alias("_run"), F.col("_steps").alias("_on"), *carried)
    joined = level.filter("_n > 1").withColumn("_parent", F.floor(F.col("_place") / RUN)).join(parents, ["_tree", "_parent"])
    at = (F.col("_place") % RUN).cast("int")
    before, after = F.slice("_run", F.lit(1), at), F.slice("_run", at + 2, F.lit(RUN))
    step = F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))
    return joined.withColumn("_steps", F.concat(F.array(step), "_on")).drop("_parent", "_run", "_on").unionByName(roots)
