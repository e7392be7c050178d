"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import batched, cut, rows_of
from quillspark.llm.columns import joined_apart, text_key
from quillspark.llm.components import connected_components

SEED = 42
WIDTH = 3
#: Fingerprints in one segment bucket that a join compares one by one; larger buckets go by midpoints.
BUCKET = 5000
MAX_DISTANCE = 2


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; without words 0."""
    words = text.lower().split()  # on bytes both are ASCII only
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits of which each is 1 if it is set in over half of ``hashes``; without any 0."""
    n, hashes = len(hashes), hashes.astype("<u8", copy=False)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, keyed: bool = False) -> DataFrame:
    """Rows (doc_id, fp) for every row of ``docs`` (doc_id, text), and t0, t1, which stand for
    the text, if ``keyed``; a null text counts as empty."""
    names = ["doc_id", *["t0", "t1"] * keyed, "fp"]
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*key, int(np.uint64(fingerprint(text or b"", width)).astype(np.int64))) for *key, text in rows_of(batches))
        return batched(rows, schema, lambda row: 8 * len(names))

    key = row_key() if keyed else row_key()[:1]
    return docs.select(*key, F.col("text").cast("binary").alias("text")).mapInArrow(run, ", ".join(f"{name} bigint" for name in names))


def row_key() -> list[Column]:
    """doc_id, and two hashes of the text: rows that agree in them are repeated rows."""
    t0, t1 = text_key(F.coalesce("text", F.lit("")))
    return [F.col("doc_id").cast("bigint").alias("doc_id"), t0.alias("t0"), t1.alias("t1")]


def near_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, that join all fingerprints (fp, each once) within two bits.

    A fingerprint has two 32-bit segments and a table for each. Of two fingerprints within
    two bits, either the high segments differ in at most one bit or the low ones are equal,
    so a query looks up the radius-1 ball of its high segment and its own low segment, and
    the complete distance is verified in the join. Fingerprints in buckets over ``bucket``
    entries are not compared one by one: two of them are within two bits just when some
    value is within one bit of both, so each value's (at most 65) neighbours are linked to
    the smallest. Those links connect the same groups; no candidate is dropped.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)

    def keyed(radius: int) -> DataFrame:
        ball = [high, *(high.bitwiseXOR(1 << k) for k in range(32 * radius))]
        entries = [F.struct(F.lit(0).alias("seg"), key.alias("key")) for key in ball] + [F.struct(F.lit(1).alias("seg"), low.alias("key"))]
        return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.seg", "e.key")

    queries, table = keyed(1), keyed(0)
    hot = cut(table.groupBy("seg", "key").count().filter(F.col("count") > bucket).select("seg", "key"))
    crowded = not hot.isEmpty()
    cold_table = table.join(hot, ["seg", "key"], "left_anti") if crowded else table
    q, t = queries.alias("q"), cold_table.alias("t")
    apart = F.bit_count(F.col("q.fp").bitwiseXOR(F.col("t.fp")))
    apart_high = F.bit_count(F.shiftrightunsigned(F.col("q.fp").bitwiseXOR(F.col("t.fp")), 32))
    links = q.join(
        t,
        (F.col("q.seg") == F.col("t.seg")) & (F.col("q.key") == F.col("t.key")) & (F.col("q.fp") < F.col("t.fp"))
        & (apart <= MAX_DISTANCE) & ((F.col("q.seg") == 0) | (apart_high == MAX_DISTANCE)),
    ).select(F.col("q.fp").alias("a"), F.col("t.fp").alias("b"))
    if crowded:
        members = cut(queries.join(hot, ["seg", "key"], "left_semi").select("fp").distinct())
        near = F.array("fp", *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), k)) for k in range(64)))
        middle = members.select("fp", F.explode(near).alias("middle"))
        least = middle.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("middle", "a")
        links = links.unionByName(middle.join(least, "middle").filter("a < fp").select("a", F.col("fp").alias("b")).distinct())
    return links


def near_duplicates(docs: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, fp, component_id).

    component_id is the smallest doc_id reachable over links of at most two bits. Empty and
    null texts have fingerprint zero and link like any other. Equal fingerprints are one
    node, so a group of copies of any size costs one row in the search. Rows that repeat a
    doc_id each come back; a null doc_id never becomes a component_id unless all its group
    are null. Texts of any length count whole, a task holding the hashes of one at a time. Other columns are ignored; no rows give no rows.
    """
    prints = cut(fingerprints(docs, width))
    named = least_of_groups(prints, F.col("doc_id"), lambda nodes: near_links(nodes, bucket)).select("fp", F.col("least").alias("component_id"))
    return joined_apart(prints, named, "fp").select("doc_id", "fp", "component_id")


def least_of_groups(prints: DataFrame, order: Column, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, least): each fingerprint with the least ``order`` of the rows of its group; ``links`` makes (a, b) of the fingerprints."""
    nodes = prints.groupBy("fp").agg(F.min(order).alias("least"))
    groups = connected_components(links(nodes.select("fp")))
    rooted = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return joined_apart(rooted.select("fp", "root"), roots, "root").select("fp", "least")


def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` (.., doc_id, t0, t1) joined with ``keys`` (doc_id, t0, t1); null doc_ids are equal."""
    k = keys.toDF("k_doc", "k0", "k1")
    return rows.join(k, F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("t0") == F.col("k0")) & (F.col("t1") == F.col("k1")), how)


def one_of_each_group(docs: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, with all columns, one for each group of :func:`near_duplicates`.

    The row with the smallest doc_id stays, a null one being the largest; at a tie, as where
    different texts share a doc_id, the one with the smallest text hashes. Of repeated rows
    (equal doc_id and text) any one. So a row goes only for another that stays.
    """
    prints = cut(fingerprints(docs, width, keyed=True))
    return keep_least(docs, prints, lambda order: least_of_groups(prints, order, lambda nodes: near_links(nodes, bucket)))


def keep_least(docs: DataFrame, prints: DataFrame, least: Callable[[Column], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that are the least of their groups; ``least(order)`` gives (fp, least)."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t0", "t1")
    later = joined_apart(prints, least(order), "fp").filter(order != F.col("least")).select("doc_id", "t0", "t1").distinct()
    repeated = cut(prints.groupBy("doc_id", "t0", "t1").count().filter("count > 1").select("doc_id", "t0", "t1"))

    whole = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    if not repeated.isEmpty():
        once = matching(whole, repeated, "left_semi").groupBy("doc_id", "t0", "t1").agg(F.first("row").alias("row"))
        whole = matching(whole, repeated, "left_anti").unionByName(once.select("row", "doc_id", "t0", "t1"))
    return matching(whole, later, "left_anti").select("row.*")
