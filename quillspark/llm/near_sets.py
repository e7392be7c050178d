"""Near copies by the exact Jaccard similarity of their sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.anchors import gram_hashes
from quillspark.llm.cluster import batched, cut, free, rows_of
from quillspark.llm.columns import joined_apart
from quillspark.llm.components import connected_components
from quillspark.llm.simhash import SEED, keep_least, least_of_groups, majority, matching, row_key
from quillspark.llm.suffix_trees import word_hashes

WIDTH = 5
#: Two sets are near from this similarity on, as a fraction, so that no rounding moves the bound.
SHARE, OF = 4, 5
#: Lists of a shingle's sets of at most this length give pairs, longer ones are compared in blocks.
LISTS = 64
#: Sets and shingles in one block of a candidate group; blocks are compared two by two.
BLOCK_SETS = 512
BLOCK_GRAMS = 1 << 20
#: SimHashes of 64 bits in segments of 16, looked up with one bit changed: all within 7 bits meet, most of those within ``APART`` too.
SEGMENTS = 4
APART = 13
#: SimHashes in one segment bucket that are compared one by one; larger ones are compared with their smallest only.
BUCKET = 1000


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of the runs of ``width`` words, each once; a shorter text is one run, an empty one none."""
    words = word_hashes(text.lower())
    return np.unique(gram_hashes(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _name(grams: np.ndarray) -> int:
    """64 bits that stand for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).astype(np.int64))


def _least_shared(n: int) -> int:
    """What a set of ``n`` shares at least with any near one."""
    return -(-n * SHARE // OF)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t0, t1, fp) of every row; ``fp`` names the set."""
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "t0", "t1", "fp")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((*key, _name(shingles(text or b"", width))) for *key, text in rows_of(batches)), schema, lambda row: 32)

    return docs.select(*row_key(), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, t0 bigint, t1 bigint, fp bigint")


def _prefixes(docs: DataFrame, width: int) -> DataFrame:
    """(fp, need, g): the smallest shingles of each set, of which near sets share ``need``.

    If two sets share o, then of the n - o + k smallest of each they share k. With k = n // 20 + 1
    on both sides that holds for the smaller k; a near set has at least 0.8 n, so n // 25 + 1 is safe.
    """
    schema = pa.schema([("fp", pa.int64()), ("need", pa.int32()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in rows_of(batches):
            grams = shingles(text or b"", width)
            n = len(grams)
            first = grams[: n - _least_shared(n) + n // 20 + 1].view(np.int64)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), _name(grams))), pa.array(np.full(len(first), n // 25 + 1, np.int32)), pa.array(first)], schema=schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(joined, "fp bigint, need int, g bigint")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(fp, grams, sim) of every row; ``sim`` is the SimHash of the shingles."""
    schema = pa.schema([("fp", pa.int64()), ("grams", pa.list_(pa.int64())), ("sim", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (shingles(text or b"", width) for (text,) in rows_of(batches))
        rows = ((_name(grams), grams.view(np.int64), int(np.uint64(majority(grams)).astype(np.int64))) for grams in found)
        return batched(rows, schema, lambda row: 8 * len(row[1]) + 24)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "fp bigint, grams array<bigint>, sim bigint")


def _able(docs: DataFrame, width: int) -> DataFrame:
    """(fp): the sets whose smallest shingles meet enough of those of other sets."""
    rows = _prefixes(docs, width)
    met = rows.groupBy("g").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("g")
    return rows.join(met, "g", "left_semi").groupBy("fp", "need").count().filter("count >= need").select("fp")


def _sets_of(docs: DataFrame, prints: DataFrame, able: DataFrame, width: int) -> DataFrame:
    """(fp, grams, sim): each of the sets ``able`` once, from one row that has it."""
    chosen = prints.join(able, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "t0", "t1")).alias("k")).select("k.*")
    whole = docs.select(F.col("text").alias("row"), *row_key())
    found = _sets(matching(whole, cut(chosen), "left_semi").select(F.col("row").alias("text")), width)
    return found.groupBy("fp").agg(F.first("grams").alias("grams"), F.first("sim").alias("sim"))


def _entries(sets: DataFrame) -> DataFrame:
    """(fp, n, g, at): of the n shingles of each set the n - ceil(0.8 n) + 1 rarest, without those of one set alone; ``at`` is the place of each
    in the set's order, from the rarest on."""
    each = sets.select("fp", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    common = each.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(common, "g").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("by"))
    # those of one set alone come first
    alone = F.col("n") - F.size("by")
    room = (F.col("n") - F.ceil(F.col("n") * SHARE / OF) + 1 - alone).cast("int")
    kept = ranked.withColumn("alone", alone).withColumn("room", room).filter("room > 0")
    return kept.select("fp", "n", "alone", F.posexplode(F.slice("by", F.lit(1), F.col("room"))).alias("k", "e")).select("fp", "n", "e.g", (F.col("alone") + F.col("k")).alias("at"))


def _may_be_near(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Whether sets whose first common shingle has these places can be near: neither may end before they share enough.
    Sizes too far apart fail too, as the smaller ends first."""
    return (OF + SHARE) * F.least(n - at, other_n - other_at) >= SHARE * (n + other_n)


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are near."""
    one = joined_apart(pairs, sets.select(F.col("fp").alias("a"), F.col("grams").alias("grams_a")), "a")
    both = joined_apart(one, sets.select(F.col("fp").alias("b"), F.col("grams").alias("grams_b")), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.filter(OF * shared >= SHARE * (F.size("grams_a") + F.size("grams_b") - shared)).select("a", "b")


def simhash_links(sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of near sets that their SimHashes bring up by multi-index hashing, each confirmed on the whole sets.

    A table has each SimHash under each of its segments. The members of a bucket are first compared with its smallest, so
    that a large group costs a pair a member; then each looks up its segments and those one bit off for SimHashes
    of other groups. Sets of 0.8 in common may lie further apart than any segment shows, so :func:`near_links` goes on from these groups.
    """
    prints = cut(sets.select("fp", "sim"))
    segment = [F.shiftrightunsigned("sim", 16 * k).bitwiseAND(0xFFFF).cast("int") for k in range(SEGMENTS)]

    def keyed(rows: DataFrame, radius: int) -> DataFrame:
        keys = [F.struct(F.lit(k).alias("seg"), key.alias("key")) for k, own in enumerate(segment) for key in (own, *(own.bitwiseXOR(F.lit(1 << bit)) for bit in range(16 * radius)))]
        return rows.withColumn("e", F.explode(F.array(*keys))).select(*rows.columns, "e.seg", "e.key")

    def close(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= APART

    own = keyed(prints, 0).withColumn("at", F.col("seg") * 65536 + F.col("key"))
    sizes = own.groupBy("at").agg(F.count("*").alias("m"), F.min(F.struct("fp", "sim")).alias("head")).filter("m > 1")
    stars = joined_apart(own, sizes, "at").filter("head.fp < fp").filter(close("sim", "head.sim")).select(F.col("head.fp").alias("a"), F.col("fp").alias("b"))
    links = cut(_near(stars.distinct(), sets))
    labelled = cut(_labelled(prints, links))
    table = keyed(labelled, 0).toDF("fp_t", "sim_t", "label_t", "seg", "key")
    hot = cut(sizes.filter(F.col("m") > bucket).select(F.floor(F.col("at") / 65536).cast("int").alias("seg"), (F.col("at") % 65536).alias("key")))
    if not hot.isEmpty():
        table = table.join(F.broadcast(hot), ["seg", "key"], "left_anti")
    met = keyed(labelled, 1).join(table, ["seg", "key"]).filter("fp < fp_t AND label <> label_t").filter(close("sim", "sim_t"))
    return links.unionByName(_near(met.select(F.col("fp").alias("a"), F.col("fp_t").alias("b")).distinct(), sets))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (fp, ..) with ``label``, the smallest set that each reaches over ``links``."""
    groups = connected_components(links).withColumnRenamed("node", "fp")
    return joined_apart(rows, groups, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_pairs(grams: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) that join all near sets of the list; with ``sides`` those of two different sides only.

    Each set is counted against all before it by the places of its shingles. A pair that the
    pairs so far join already is left out.
    """
    sizes = np.array([len(x) for x in grams])
    owner = np.repeat(np.arange(len(grams)), sizes)
    every, at = np.unique(np.concatenate(grams), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holders, start = owner[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(every)))]
    label = np.arange(len(grams))
    out, end = [], 0
    for i, n in enumerate(sizes):
        own = at[end : end + n]
        end += n
        many = start[own + 1] - start[own]
        places = np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(holders[places], minlength=len(grams))[:i]
        near = OF * shared >= SHARE * (n + sizes[:i] - shared)
        if sides is not None:
            near &= sides[:i] != sides[i]
        for j in np.flatnonzero(near):
            if label[i] != label[j]:
                out.append((int(j), i))
                label[label == label[i]] = label[j]
    return out


def near_links(
    docs: DataFrame, prints: DataFrame, width: int = WIDTH, lists: int = LISTS, block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS
) -> DataFrame:
    """Links (a, b) that join all near sets of ``prints``, the names of the texts of ``docs``.

    SimHash brings up candidates first (:func:`simhash_links`). What it joins is not looked at again; all other sets are, so
    that no link is lost. Exact, in steps that only leave out what can't be near or is joined already: sets whose smallest shingles no
    other set shares; shingles of one set alone; with a set's shingles from the rarest on, all behind the first
    n - 0.8 n + 1; and pairs whose places of a shingle leave too little. Each shingle's sets are first compared with the
    smallest of them. Where the rest of a list still has two groups, lists of at most ``lists`` sets give their pairs of different
    groups, so pairs grow with the sets; longer ones are compared in blocks (``_in_blocks``).
    """
    able = cut(_able(docs, width))
    free(docs.sparkSession)
    sets = cut(_sets_of(docs, prints, able, width))
    free(docs.sparkSession)
    met = cut(simhash_links(sets))
    free(docs.sparkSession)
    entries = cut(_labelled(_entries(sets), met))
    free(docs.sparkSession)
    heads = entries.groupBy("g").agg(F.min(F.struct("fp", "n", "at", "label")).alias("head"), F.max("fp").alias("z")).filter("head.fp < z").select("g", "head")
    listed = joined_apart(entries, heads, "g").filter("head.fp < fp")
    able_to = _may_be_near(F.col("n"), F.col("at"), F.col("head.n"), F.col("head.at"))
    stars = listed.filter(able_to & (F.col("label") != F.col("head.label"))).select(F.col("head.fp").alias("a"), F.col("fp").alias("b"))
    links = cut(met.unionByName(_near(stars.distinct(), sets)))
    free(docs.sparkSession)

    grouped = _labelled(listed.select("fp", "n", "g", "at"), links)
    apart = grouped.groupBy("g").agg(F.count("*").alias("m"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("g", "m")
    rest = cut(joined_apart(grouped, apart, "g"))
    x, y = (rest.filter(F.col("m") <= lists).select("g", *(F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "at", "label"))) for side in "xy")
    able_to = _may_be_near(F.col("n_x"), F.col("at_x"), F.col("n_y"), F.col("at_y"))
    pairs = x.join(y, "g").filter("fp_x < fp_y AND label_x <> label_y").filter(able_to).select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b"))
    links = links.unionByName(_near(pairs.distinct(), sets))
    longer = rest.filter(F.col("m") > lists)
    return links if longer.isEmpty() else links.unionByName(_in_blocks(longer.select("fp", "g"), sets, block_sets, block_grams))


def _in_blocks(entries: DataFrame, sets: DataFrame, block_sets: int, block_grams: int) -> DataFrame:
    """Links (a, b) that join all near sets that meet in ``entries`` (fp, g).

    Sets that meet are one candidate group (found by stars, not by pairs), whose sets are compared in blocks two by
    two. The comparisons grow with the square of a candidate group, the rows with its blocks.
    """
    least = entries.groupBy("g").agg(F.min("fp").alias("a"))
    groups = connected_components(joined_apart(entries, least, "g").select("a", F.col("fp").alias("b")))

    members = cut(joined_apart(sets, groups.select(F.col("node").alias("fp"), F.col("label").alias("group")), "fp"))
    size = members.groupBy("group").agg(F.count("*").alias("m"), F.sum(F.size("grams")).alias("s"))
    size = size.select("group", F.greatest(F.ceil(F.col("m") / block_sets), F.ceil(F.col("s") / block_grams)).cast("int").alias("k"))
    placed = joined_apart(members, size, "group").withColumn("own", F.pmod(F.xxhash64("fp"), "k").cast("int"))
    placed = placed.select("fp", "grams", "group", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cells = placed.select("fp", "grams", "own", "group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        names, sides = cell.column("fp").to_numpy(), cell.column("own").to_numpy()
        grams = [x.values.to_numpy() for x in cell.column("grams")]
        one = cell.column("x")[0] == cell.column("y")[0]
        pairs = np.array(near_pairs(grams, None if one else sides), np.int64).reshape(-1, 2)
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    return cells.groupBy("group", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def one_of_each_group(
    docs: DataFrame, width: int = WIDTH, lists: int = LISTS, block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS
) -> DataFrame:
    """The rows of ``docs``, with all columns, one for each group of near copies.

    Near are texts whose sets of five-word shingles (A-Z lower-cased, split at ASCII white
    space) have a Jaccard similarity of 0.8 or more; groups are joined over such pairs. A
    text of fewer words is one shingle; empty and null texts are copies of each other. The
    row that stays is chosen as in :func:`simhash.one_of_each_group`. Texts of any length count whole; no rows give no rows.
    """
    prints = cut(_prints(docs, width))
    return keep_least(docs, prints, lambda order: least_of_groups(prints, order, lambda _: near_links(docs, prints, width, lists, block_sets, block_grams)))
