"""SimHash near-duplicates: fingerprints over shingles, linked by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import batch, keep_rows, per_batch, raw_hash, require_columns, stage
from clauseloom.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
# Fingerprints that share a route and are joined in one task at most; larger routes are split by longer ones.
ROUTE_LIMIT = 4096
ROWS_AT_ONCE = 100_000

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("fingerprint", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words; of the whole sequence if it has fewer words; none without words."""
    words = text.lower().split()  # on bytes, both touch ASCII only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends[: max(0, len(words) - size)].tolist()]
    last = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, raw, fingerprint as a signed long) of every whole text."""
    require_columns(documents, "doc_id", "text")

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            found = [fingerprint(shingle_hashes(t.as_py(), shingle, seed)) for t in rows["text"]]
            yield batch(_FINGERPRINTS, {"doc_id": rows["doc_id"], "raw": rows["raw"], "fingerprint": found})

        return step

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        raw_hash("text").alias("raw"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return per_batch(rows, work, "doc_id long, raw long, fingerprint long")


def trie_self_join(codes: np.ndarray, starts: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions in the same group whose codes differ in at most ``max_bits`` bits.

    ``codes`` are distinct within a group and sorted there, so a range of them with a common prefix is a node of the
    group's binary trie. ``starts`` holds where the groups begin, and the end of the last. All tries are traversed
    together, one bit at a time: a pair of nodes becomes its pairs of children, children that part at this bit
    add one to the differing bits, and pairs over the budget go. A pair of leaves is settled at once.
    """
    lo, hi = starts[:-1], starts[1:]
    wide = hi - lo > 1
    frontier = np.stack([lo[wide], hi[wide], lo[wide], hi[wide], np.zeros(wide.sum(), np.int64)])
    left, right = [], []
    for bit in range(63, -1, -1):
        if not frontier.shape[1]:
            break
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        al, ah, bl, bh, spent = frontier
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        apart, same = spent + 1, al == bl
        cross = ~same
        children = np.concatenate(
            [
                np.stack([al, am, bl, bm, spent]),
                np.stack([am, ah, bm, bh, spent]),
                np.stack([al, am, bm, bh, apart]),
                np.stack([am, ah, bl, bm, apart])[:, cross],  # for a node with itself this is the pair above
            ],
            axis=1,
        )
        al, ah, bl, bh, spent = children
        alive = (spent <= max_bits) & (ah > al) & (bh > bl) & ((al != bl) | (ah - al > 1))
        children = children[:, alive]
        al, ah, bl, bh, _ = children
        leaves = (ah - al == 1) & (bh - bl == 1)
        i, j = al[leaves], bl[leaves]
        near = np.bitwise_count(codes[i] ^ codes[j]) <= max_bits
        left.append(i[near])
        right.append(j[near])
        frontier = children[:, ~leaves]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` positions the smallest position it is connected with by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _join_routes(max_bits: int):
    """Self-join of the tries of all routes in a partition that is sorted by (route, value, fingerprint)."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        route, value = rows["route"].to_numpy(), rows["value"].to_numpy()
        codes, ids = rows["fingerprint"].to_numpy().view(np.uint64), rows["id"].to_numpy()
        # Signed order puts codes with a leading 1 first; a trie wants them by their bits.
        order = np.lexsort((codes, value, route))
        route, value, codes, ids = route[order], value[order], codes[order], ids[order]
        new = np.flatnonzero((route[1:] != route[:-1]) | (value[1:] != value[:-1])) + 1
        i, j = trie_self_join(codes, np.concatenate([[0], new, [len(codes)]]), max_bits)
        root = spanning(i, j, len(codes))
        linked = np.flatnonzero(root != np.arange(len(codes)))
        return batch(_LINKS, {"u": ids[linked], "v": ids[root[linked]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < ROWS_AT_ONCE:
                continue
            # All but the last group is complete.
            route, value = held["route"].to_numpy(), held["value"].to_numpy()
            last = int(np.argmax((route == route[-1]) & (value == value[-1])))
            if last:
                yield links(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None:
            yield links(held)

    return run


def routes(blocks: int, max_bits: int) -> list[int]:
    """Masks that keep all but ``max_bits`` of ``blocks`` equal blocks of bits.

    Codes that differ in at most ``max_bits`` bits agree on all of at least one mask.
    """
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [reduce(int.__or__, kept) for kept in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, limit: int = ROUTE_LIMIT) -> list[DataFrame]:
    """Stored tables (u, v) of links that connect all nodes (id, fingerprint) within ``max_bits`` of each other.

    Nodes hold each fingerprint once. Each is sent along several routes, the bits under a mask; fingerprints to be
    linked share a route, and a trie self-join per route finds them. Of a route's links a spanning forest is kept.
    Routes of more than ``limit`` fingerprints are not joined: their fingerprints take the next round, where routes
    fix more bits, and the last round leaves 8 bits free, so at most 256 share a route. Route sizes are summed before
    they are shuffled.
    """
    found, pending = [], nodes
    rounds = (max_bits + 2, max_bits + 4, max_bits + 8, 8 * max_bits)
    for blocks in rounds:
        masks = routes(blocks, max_bits)
        kinds = F.array(*[F.struct(F.lit(k).alias("route"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value"))
                          for k, m in enumerate(masks)])
        routed = pending.select("id", "fingerprint", F.inline(kinds))
        sizes = stage(routed.groupBy("route", "value").agg(F.count("*").alias("n")).filter("n > 1"), "route-sizes")
        last = blocks == rounds[-1]
        shared = sizes if last else sizes.filter(F.col("n") <= limit)
        joined = routed.join(shared.select("route", "value"), ["route", "value"], "left_semi")
        # The join may split a large partition; a route must be whole.
        whole = joined.repartition("route", "value").sortWithinPartitions("route", "value")
        found.append(stage(whole.mapInArrow(_join_routes(max_bits), "u long, v long"), "links"))
        if last:
            break
        crowded = sizes.filter(F.col("n") > limit).select("route", "value")
        if crowded.isEmpty():
            break
        pending = stage(
            routed.join(crowded, ["route", "value"], "left_semi").select("id", "fingerprint").distinct(), "crowded"
        )
    return found


def _members(documents: DataFrame, shingle: int, max_bits: int, limit: int) -> DataFrame:
    if not 1 <= max_bits <= 4:
        raise ValueError("max_bits must be from 1 to 4")
    prints = stage(fingerprints(documents, shingle), "fingerprints")
    # A fingerprint is its own node number, so that rows without doc_id are nodes like any other.
    nodes = stage(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("id", F.col("fingerprint")), "nodes"
    )
    found = links(nodes, max_bits, limit)
    roots = components(reduce(DataFrame.unionByName, found))
    rooted = nodes.join(roots, nodes["id"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "id").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    group = rooted.join(least, "root").select("fingerprint", "root", "component_id")
    return prints.join(group, "fingerprint", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
        "raw",
        "root",
    )


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, limit: int = ROUTE_LIMIT
) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at ``max_bits`` or fewer differing bits.

    ``component_id`` is the smallest doc_id that links lead to, the document's own included. Whole texts are read,
    repeated shingles count each time. Texts with fewer words than a shingle have one shingle, texts without words
    (null, empty, blank) the fingerprint zero, which links like any other. Rows that repeat a doc_id are rows of
    their own; a row without doc_id links like any other and gets the component_id of its group, null if no row of it
    has a doc_id. Other columns are ignored, an empty table gives no rows.

    Equal fingerprints are one node, so copies are never paired. Texts are read once and not shuffled.
    """
    return _members(documents, shingle, max_bits, limit).drop("raw", "root")


def representatives(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, with all columns: the one with the smallest doc_id.

    Of rows that repeat this doc_id with other texts one stays, and one of a group whose rows all lack a doc_id, each
    time the one with the smallest hash of its text. Null and empty texts form a group with others of fingerprint zero.
    Columns may have any names; an empty table gives no rows.
    """
    members = _members(documents, shingle, max_bits, ROUTE_LIMIT)
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "raw")
    # Groups whose smallest doc_id is the same share a document that is there with several texts.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("root")))
    first = members.groupBy(group.alias("group")).agg(F.min(place).alias("first"))
    return keep_rows(documents, first.select("first.doc_id", "first.raw"))
