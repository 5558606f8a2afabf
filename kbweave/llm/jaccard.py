"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order, rare ones first; pivots cut it into fragments, and every document's set
into one segment a fragment. The overlap of a pair is counted fragment by fragment and summed, so no row holds
a whole long document and no task a whole group.

* **Classes**: documents with equal sets are one node; copies cost one row each and no pair.
* **Order**: shingles are counted by ``2^18`` hashed buckets over all documents, an array of fixed size. The order is (bucket
  count, hash). Any total order gives the same result; this one puts frequent shingles last.
* **Candidates**: similar sets share a shingle in their prefixes, at positions that leave room for the overlap needed. A pair is ruled out before its
  fragments are sent if their bitmaps (some 8 bits a shingle) differ too much: a bit that one has and the other has not is a shingle
  not shared, so no similar pair is lost.
* **Components without all pairs**: the most central node of a posting list (fewest rarer shingles) is its hub. In each round a node is
  compared with the hubs that share most lists with it: one in the first round, twice as many in each that follows. Members that are connected
  need no further comparison. What is left, pairs of nodes of different components that were not compared yet, is compared in full, so no
  link between components is lost and a group of near copies costs about a pair per member.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbweave.llm.common import WordIds, bounded, text_batches, written

BITS = 18
WIDTH = 1 << BITS
BLOCK = 1 << 13
FRAGMENTS = 16
EARLY_FRAGMENTS = 2
HUB_ROUNDS = 4  # at most; another round follows only while each halves what is open
_FACTORS = np.random.default_rng(20_011).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose low bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(n, size)
    total = np.full(n - width + 1, width * 0xD6E8FEB86659FD93 & (1 << 64) - 1, dtype=np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _FACTORS[j]
    return np.unique(mixed(total))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    ids = WordIds()
    for batch, texts in text_batches(batches):
        yield batch, [shingles(ids.of(text.lower().split()), size) for text in texts]


def _node(found: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit signatures of a set; the first names the node."""
    import xxhash

    data = found.tobytes()
    return xxhash.xxh3_64_intdigest(data) - (1 << 63), xxhash.xxh3_64_intdigest(data, seed=7) - (1 << 63)


def classes(documents: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts: ``doc_id, n, node, proof`` of every row, and the documents that hold a shingle of each bucket.

    ``n`` is the size of the set. A task adds its counts into an array of fixed size and hands that on in packed blocks, as rows with a ``block``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(WIDTH, dtype=np.int64)
        names = ["doc_id", "n", "node", "proof", "block", "counts"]
        for batch, sets in _sets(batches, size):
            if sets:
                sums += np.bincount((np.concatenate(sets) & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
            pair = [_node(found) for found in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in pair], pa.int64()), pa.array([b for _, b in pair], pa.int64()),
                    pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
                ],
                names=names,
            )
        parts = [(b, sums[b * BLOCK : (b + 1) * BLOCK]) for b in range(WIDTH // BLOCK)]
        parts = [(b, zlib.compress(part.astype(np.int32).tobytes(), 1)) for b, part in parts if part.any()]
        nothing = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nothing, nothing, nothing, nothing, pa.array([b for b, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names
        )

    def add(key: tuple, group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BLOCK, dtype=np.int64)
        for part in group:
            for value in part["counts"]:
                total += np.frombuffer(zlib.decompress(value), dtype=np.int32)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    rows = written(documents.mapInArrow(run, "doc_id long, n long, node long, proof long, block int, counts binary"), "classes")
    sums = np.zeros(WIDTH, dtype=np.int64)
    blocks = rows.filter("block is not null").select("block", "counts")
    for row in blocks.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        sums[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype=np.int64)
    return rows.filter("block is null").select("doc_id", "n", "node", "proof"), sums


def global_order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each bucket, rarest first, and its fragment; pivots give the fragments equal shares of all shingles."""
    order = np.lexsort((np.arange(WIDTH), counts))
    rank = np.empty(WIDTH, dtype=np.int32)
    rank[order] = np.arange(WIDTH, dtype=np.int32)
    share = np.cumsum(counts[order]) / max(int(counts.sum()), 1)
    fragment = np.empty(WIDTH, dtype=np.int32)
    fragment[order] = np.minimum((share * FRAGMENTS).astype(np.int32), FRAGMENTS - 1)
    return rank, fragment


def _ordered(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return found[np.lexsort((found, rank[(found & np.uint64(WIDTH - 1)).astype(np.int64)]))]


def postings(documents: DataFrame, size: int, percent: int, rank: np.ndarray) -> DataFrame:
    """``shingle, node, n, pos``: the prefix of each distinct set in the global order.

    A set of n shingles shares at least ``percent`` of them with any partner, so one of the first n minus that plus 1 is
    shared. A task hands on a set once, as far as it remembers; equal sets of other tasks give equal rows.
    """
    known = documents.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, size):
            heads, nodes, sizes, places = [], [], [], []
            for found in sets:
                n = len(found)
                if not n:
                    continue
                node = _node(found)[0]
                if node in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(node)
                head = _ordered(found, known.value)[: n - (percent * n + 99) // 100 + 1]
                heads.append(head)
                nodes.append(np.full(len(head), node, dtype=np.int64))
                sizes.append(np.full(len(head), n, dtype=np.int32))
                places.append(np.arange(len(head), dtype=np.int32))
            if heads:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                    names=["shingle", "node", "n", "pos"],
                )

    return documents.mapInArrow(run, "shingle long, node long, n int, pos int")


BITMAP = -1  # in place of a fragment's number


def bitmap(found: np.ndarray) -> np.ndarray:
    """A set's bits, about 8 a shingle, in a number of words that is a power of two; folding its halves gives the one of half the size."""
    words = 1 << max(0, (len(found) - 1).bit_length() - 3)
    place = (found >> np.uint64(BITS)).astype(np.int64) & (64 * words - 1)
    bits = np.zeros(64 * words, dtype=np.uint8)
    bits[place] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def segments(texts: DataFrame, size: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``node, fragment, part``: each text's set cut at the pivots, and its bitmap as fragment ``BITMAP``."""
    known = texts.sparkSession.sparkContext.broadcast(order[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, size):
            nodes, cuts, parts = [], [], []
            for found in sets:
                if len(found):
                    node = _node(found)[0]
                    nodes.append(node)
                    cuts.append(BITMAP)
                    parts.append(bitmap(found))
                    cut = known.value[(found & np.uint64(WIDTH - 1)).astype(np.int64)]
                    at = np.argsort(cut, kind="stable")
                    values, starts = np.unique(cut[at], return_index=True)
                    for value, part in zip(values.tolist(), np.split(found[at], starts[1:])):
                        nodes.append(node)
                        cuts.append(value)
                        parts.append(part.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(cuts, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["node", "fragment", "part"]
            )

    return texts.mapInArrow(run, "node long, fragment int, part array<long>")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Condition on an overlap o in hundredths: 100 o >= percent (a + b - o)."""
    return percent * (a.cast("long") + b.cast("long"))


def _partial(pairs: DataFrame, parts: DataFrame, first: int, last: int) -> DataFrame:
    """``a, b, common, sa, sb``: overlap and sizes of the pairs' segments, summed over fragments ``first`` to ``last``.

    A segment that came twice, from repeated ids, gives the same numbers and counts once.
    """
    chosen = parts.where(F.col("fragment").between(first, last))
    cut = pairs.select("a", "b").withColumn("fragment", F.explode(F.sequence(F.lit(first), F.lit(last))))
    left = chosen.select(F.col("node").alias("a"), "fragment", F.col("part").alias("pa"))
    right = chosen.select(F.col("node").alias("b"), "fragment", F.col("part").alias("pb"))
    both = cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    one = F.struct("fragment", F.size(F.array_intersect("pa", "pb")).alias("common"), F.size("pa").alias("sa"), F.size("pb").alias("sb"))
    found = both.select("a", "b", one.alias("one")).groupBy("a", "b").agg(F.collect_set("one").alias("ones"))
    total = lambda name: F.aggregate("ones", F.lit(0).cast("long"), lambda sum_, x: sum_ + x[name]).alias(name)
    return found.select("a", "b", total("common"), total("sa"), total("sb"))


def _possible(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b, na, nb`` that their bitmaps do not rule out. Sizes of similar sets differ little, so one fold makes bitmaps equally long."""
    bits = parts.where(F.col("fragment") == BITMAP).groupBy("node").agg(F.first("part").alias("bits"))
    both = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")
    k = F.least(F.size("x"), F.size("y"))
    folded = lambda v: F.when(
        F.size(v) > k, F.zip_with(F.slice(v, F.lit(1), k), F.slice(v, k + 1, k), lambda p, q: p.bitwiseOR(q))
    ).otherwise(F.col(v))
    alone = lambda v, w: F.aggregate(F.zip_with(v, w, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, m: n + m)
    both = both.where(F.greatest(F.size("x"), F.size("y")) <= 2 * k).select("a", "b", "na", "nb", folded("x").alias("x"), folded("y").alias("y"))
    shared = F.least(F.col("na") - alone("x", "y"), F.col("nb") - alone("y", "x"))
    return both.where((100 + percent) * shared.cast("long") >= _needed(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b, na, nb`` the pairs that are similar: partial overlaps by fragment, summed a pair.

    Bitmaps rule out most pairs, and the first fragments more of them: what they share and all that is left of the smaller rest is
    too little. Only pairs that can still reach the overlap have their other segments sent.
    """
    if percent > 50:  # else similar sets may differ too much in size for one fold
        pairs = written(_possible(pairs, parts, percent), "possible")
    early = _partial(pairs, parts, 0, EARLY_FRAGMENTS - 1)
    some = pairs.join(early, ["a", "b"], "left").na.fill(0, ["common", "sa", "sb"])
    reach = F.col("common") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb"))
    needed = _needed(F.col("na"), F.col("nb"), percent)
    some = written(some.where((100 + percent) * reach >= needed).select("a", "b", "na", "nb", F.col("common").alias("before")), "reachable")
    late = _partial(some, parts, EARLY_FRAGMENTS, FRAGMENTS - 1).select("a", "b", "common")
    total = F.col("before") + F.coalesce("common", F.lit(0))
    return some.join(late, ["a", "b"], "left").where((100 + percent) * total >= needed).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of all linked nodes: every node takes its smallest neighbour, links contract, until none is left.

    Node names are hashes, so each step merges a fixed share of the nodes on average.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        step = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "labels")
        start = F.col("a").alias("node")
        found = written(
            step.select(start, F.col("to").alias("component")) if found is None
            else found.join(step.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")),
            "components",
        )
        edges = written(
            edges.join(step.withColumnRenamed("to", "ca"), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("cb")), "b")
            .filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(),
            "edges",
        )
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)


def _room(left: str, right: str, percent: int) -> Column:
    """Whether sizes and positions of a shared shingle, if it is the first shared one, leave room for the overlap needed."""
    na, nb, pa_, pb = (F.col(f"{side}.{name}") for name in ("n", "pos") for side in (left, right))
    fits = 100 * F.least(na, nb).cast("long") >= percent * F.greatest(na, nb).cast("long")
    return fits & ((100 + percent) * F.least(na - pa_, nb - pb).cast("long") >= _needed(na, nb, percent))


def _early(percent: int) -> Column:
    """Whether a posting can be the shared one of its node and a partner that is no smaller.

    With such a partner at least ``2 percent / (100 + percent)`` of the node's shingles are shared, so a shorter prefix has one.
    """
    return F.expr(f"pos < n - ceil({2 * percent} * cast(n as long) / {100 + percent}) + 1")


def _all_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Rows ``x, y`` of a list's nodes of different components, the smaller set first."""
    row = F.struct("node", "n", "pos", "component")
    left = lists.where(_early(percent)).select("shingle", row.alias("x"))
    both = left.join(lists.select("shingle", row.alias("y")), "shingle")
    return both.where((F.struct("x.n", "x.node") < F.struct("y.n", "y.node")) & (F.col("x.component") != F.col("y.component")))


def _hub_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Rows ``x, y`` of a list's nodes and its hub."""
    hubs = lists.groupBy("shingle").agg(F.min(F.struct("pos", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "component")).alias("y"))
    both = lists.select("shingle", F.struct("node", "n", "pos", "component").alias("x")).join(hubs, "shingle").drop("shingle")
    return both.where(F.col("x.component") != F.col("y.component")).select("x", F.struct("y.node", "y.n", "y.pos", "y.component").alias("y"))


def _pairs(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """``a, b, na, nb, lists`` of the pairs not in ``done``, the smaller name first, with the lists they share; ``asks`` is the node x."""
    swap = F.col("x.node") > F.col("y.node")
    pick = lambda name, low: F.when(swap == F.lit(low), F.col(f"y.{name}")).otherwise(F.col(f"x.{name}"))
    found = rows.select(
        F.col("x.node").alias("asks"), pick("node", True).alias("a"), pick("node", False).alias("b"), pick("n", True).alias("na"), pick("n", False).alias("nb")
    )
    found = found.groupBy("asks", "a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("lists"))
    return found if done is None else found.join(done, ["a", "b"], "left_anti")


def _closest(pairs: DataFrame, partners: int, turn: int) -> DataFrame:
    """Of each asking node the pairs with the partners it shares most lists with."""
    order = [F.col("lists").desc(), F.xxhash64("a", "b", F.lit(turn))]
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("asks").orderBy(*order))).where(F.col("place") <= partners)


def _open_lists(shared: DataFrame, percent: int) -> DataFrame:
    """Posting lists that hold nodes of several components, without the nodes that no other of the list can be similar to.

    ``_room`` for a pair means that each one's ``slack`` covers ``percent`` times the other's size: a node needs a slack for the smallest
    size in the list, and the list a slack for the node's size.
    """
    slack = F.expr(f"{100 + percent} * cast(n - pos as long) - {percent} * cast(n as long)")
    lists = shared.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max(_early(percent)).alias("early"),
        F.max(slack).alias("most"), F.min("n").alias("least"),
    ).filter("low <> high and early")
    both = shared.join(lists, "shingle").where((slack >= percent * F.col("least")) & (F.col("most") >= percent * F.col("n")))
    return both.select("shingle", "node", "n", "pos", "component")


def linked_nodes(documents: DataFrame, base: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame | None:
    """``node, component`` of the nodes with links, or None if no two sets share a prefix shingle."""
    order = global_order(counts)
    heads = written(postings(documents, size, percent, order[0]), "postings")
    # Copies of one set in several tasks are one node; lists that hold but one fall out after the join.
    several = heads.groupBy("shingle").agg(F.count("*").alias("size"), F.max(_early(percent)).alias("early"))
    shared = heads.join(several.filter("size > 1 and early").select("shingle"), "shingle")
    shared = shared.groupBy("shingle", "node").agg(F.max("n").alias("n"), F.max("pos").alias("pos"))
    shared = written(_open_lists(shared.withColumn("component", F.col("node")), percent), "shared")
    lowest = base.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    links = parts = have = found = done = None
    turn, before, now = 0, None, shared.count()
    while now:
        last = turn == HUB_ROUNDS or before is not None and 2 * now >= before
        if last:
            chosen = _pairs(_all_pairs(shared, percent).where(_room("x", "y", percent)), done)
        else:
            chosen = _closest(_pairs(_hub_pairs(shared, turn).where(_room("x", "y", percent)), done), 1 << turn, turn)
        pairs = written(chosen.select("a", "b", "na", "nb").distinct(), "pairs")
        # Segments of the nodes that are compared for the first time; few ids are broadcast, so the texts are not shuffled.
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if have is not None:
            nodes = nodes.join(have, "node", "left_anti")
        nodes = written(nodes.join(lowest, "node"), "nodes")
        texts = documents.join(bounded(nodes.select("doc_id").distinct()), "doc_id", "left_semi")
        if not nodes.filter("doc_id is null").isEmpty():
            texts = texts.unionByName(documents.filter("doc_id is null"))
        more = written(segments(texts, size, order), "segments")
        parts = more if parts is None else parts.unionByName(more)
        have = nodes.select("node") if have is None else have.unionByName(nodes.select("node"))
        fresh = written(verified(pairs, parts, percent), "links")
        links = fresh if links is None else links.unionByName(fresh)
        found = components(links)
        if last:
            break
        done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
        named = shared.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        before, shared = now, written(_open_lists(written(named, "named"), percent), "open")
        turn, now = turn + 1, shared.count()
    return found


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents`` (``doc_id``, ``text``; other columns are not read).

    Words are runs of other than ASCII white space with A-Z lower-cased. Two rows link when
    ``100 |A and B| >= percent |A or B|``; the component id is the smallest doc_id reachable by links. Null and empty texts, and texts without
    words, have no shingles and link with nothing. Repeated rows are each returned. A null id is returned as null and is no
    smallest id unless all ids reachable are null. Shingles are compared by 64-bit hashes; equal sets are proven
    by a second signature, and a clash of names ends the job.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base, counts = classes(rows, size)
    clash = F.when(F.min("proof") == F.max("proof"), F.min("doc_id")).otherwise(F.raise_error(F.lit("two sets share a signature")).cast("long"))
    first = base.filter("n > 0").groupBy("node").agg(clash.alias("lowest"))
    found = linked_nodes(rows, base, counts, size, percent)
    if found is not None:
        first = first.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        lowest = first.groupBy("component").agg(F.min("lowest").alias("least"))
        first = first.join(lowest, "component").select("node", F.col("least").alias("lowest"))
    out = base.join(first, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document a component, the one with the smallest id; repeated equal rows become one.

    Rows without an id can't be named as anyone's copy and stay.
    """
    groups = near_duplicates(documents, size, percent)
    keep = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = documents.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(documents.filter("doc_id is null"))
