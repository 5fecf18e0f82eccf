"""MinHash near-duplicates by HyperMinHash: registers of leading zeros and mantissa bits, banded, then confirmed.

A set of shingle hashes is dealt into 128 buckets by seven bits; of the least remaining value in a bucket a register
of 16 bits is kept, its leading zeros and the ten bits after the leading one. An empty bucket takes the register of
the first filled one in an order of its own, so that short texts have 128 registers as well, each equal with the
probability of the similarity. Four registers make a band, 32 bands a sketch of 256 bytes, whatever the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import batch, per_batch, raw_hash, require_columns, stage
from clauseloom.llm.components import components
from clauseloom.llm.simhash import shingle_hashes

SHINGLE = 3
PERCENT = 85
SEED = 7
BUCKET_BITS, MANTISSA_BITS, PER_BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // PER_BAND
VALUE_BITS = 64 - BUCKET_BITS
# A pair is dropped unseen only if a pair at the threshold would agree on so few registers with this probability.
LOSS = 1e-10
# Texts with one band key that are compared in one task, and bytes of their sets; larger keys are told apart by further bands.
ROUTE_LIMIT, ROUTE_BYTES = 4_096, 64 << 20
DEPTH = 3
# Partners of one text that are confirmed in one task.
PARTNERS = 2_000
# Pairs whose registers are compared at a time.
PAIRS_AT_ONCE = 1 << 16

_SKETCHES = pa.schema(
    [("doc_id", pa.int64()), ("raw", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("filled", pa.binary())]
)
SKETCHES = "doc_id long, raw long, n long, digest binary, bands array<long>, filled binary"
_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SETS = pa.schema([("node", pa.int64()), ("items", pa.binary())])


def hash_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted by bucket, then by value."""
    hashes = shingle_hashes(text, shingle, SEED)
    return np.unique((hashes >> np.uint64(BUCKET_BITS)) | (hashes << np.uint64(VALUE_BITS)))


def registers(items: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: leading zeros (plus one) above the mantissa; 0 for an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(items):
        bucket = (items >> np.uint64(VALUE_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        least = items[first] & np.uint64((1 << VALUE_BITS) - 1)
        # The length in bits by halving: a float would round long numbers up.
        length, rest = np.zeros(len(least), np.uint64), least.copy()
        for step in (32, 16, 8, 4, 2, 1):
            high = rest >= np.uint64(1 << step)
            length[high] += np.uint64(step)
            rest[high] >>= np.uint64(step)
        length += (rest > 0).astype(np.uint64)
        zeros = np.uint64(VALUE_BITS) - length
        mantissa = ((least << (zeros + np.uint64(1))) >> np.uint64(VALUE_BITS - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
        out[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa
    return out


def _orders() -> np.ndarray:
    """Per bucket the order in which it looks for a filled one."""
    draws = np.random.default_rng(SEED)
    return np.stack([draws.permutation(BUCKETS) for _ in range(BUCKETS)])


def filled_up(found: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Registers with those of empty buckets borrowed; all zero for the empty set."""
    empty = np.flatnonzero(found == 0)
    if not len(empty) or len(empty) == BUCKETS:
        return found
    out = found.copy()
    seen = found[orders[empty]]
    out[empty] = seen[np.arange(len(empty)), (seen > 0).argmax(axis=1)]
    return out


def sketches(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, raw, n, digest, bands, filled) of every whole text.

    The set's size and digest, 32 bands of four registers, and a bit per bucket that says whether it had a value.
    """
    require_columns(documents, "doc_id", "text")

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        orders = _orders()

        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            n, digests, bands, filled = [], [], [], []
            for text in rows["text"]:
                items = hash_set(text.as_py(), shingle)
                n.append(len(items))
                digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                own = registers(items)
                bands.append(filled_up(own, orders).view("<i8"))
                filled.append(np.packbits(own > 0).tobytes())
            columns = (rows["doc_id"], rows["raw"], n, digests, bands, filled)
            yield batch(_SKETCHES, dict(zip(_SKETCHES.names, columns)))

        return step

    return per_batch(_rows(documents), work, SKETCHES)


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        raw_hash("text").alias("raw"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two unrelated sets of ``n`` and ``m`` hashes share by chance.

    A register's least value lies in the range of each count of leading zeros with a known probability; inside such
    a range the mantissas of two sets agree once in 2^10.
    """
    edges = np.concatenate([np.exp2(-np.arange(VALUE_BITS + 1.0)), [0.0]]) / BUCKETS  # 1, 1/2, 1/4, ..., 0
    above = [np.exp(np.log1p(-edges)[None, :] * size[:, None]) for size in (n, m)]
    in_range = [a[:, 1:] - a[:, :-1] for a in above]
    return BUCKETS * (in_range[0] * in_range[1]).sum(axis=1) / (1 << MANTISSA_BITS)


def _cutoffs(percent: int) -> np.ndarray:
    """Per number of occupied registers the least share that pairs at the threshold reach but for ``LOSS``."""
    share, least = percent / 100, [0.0]
    for size in range(1, BUCKETS + 1):
        tail, hits = 0.0, 0
        while (tail := tail + comb(size, hits) * share**hits * (1 - share) ** (size - hits)) < LOSS:
            hits += 1
        least.append(hits / size)
    return np.array(least)


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard similarity less expected collisions, occupied registers) of pairs of register rows."""
    occupied = ((left > 0) | (right > 0)).sum(axis=1)
    agree = ((left == right) & (left > 0)).sum(axis=1)
    chance = expected_collisions(n, m)
    return np.maximum(agree - chance, 0) / np.maximum(occupied - chance, 1e-9), occupied


class Likely:
    """Which pairs of sketches allow the threshold: by their sizes, and by their own registers less collisions."""

    def __init__(self, percent: int) -> None:
        self.percent, self.least = percent, _cutoffs(percent)

    def __call__(self, left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether, for rows of registers and set sizes."""
        share, occupied = estimate(left, right, n, m)
        # The correction takes off less than one register: allow for it, so that it never loses a pair.
        slack = expected_collisions(n, m) / np.maximum(occupied, 1) + 1e-9
        fits = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        return fits & (share >= self.least[occupied] - slack)


def _own_registers(bands: pa.Array, filled: pa.Array) -> np.ndarray:
    """The registers without borrowed ones, a row per sketch."""
    every = bands.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, BUCKETS)
    bits = np.unpackbits(np.frombuffer(b"".join(filled.to_pylist()), np.uint8)).reshape(-1, BUCKETS)
    return every * bits


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and corrected estimate allow the threshold."""
    columns = ("n", "bands", "filled")
    one, two = (
        nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]) for end in "uv"
    )
    known = pairs.join(one, "u").join(two, "v").filter(
        100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    )

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        likely = Likely(percent)

        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            if not rows.num_rows:
                return
            left, right = (_own_registers(rows[f"bands_{end}"], rows[f"filled_{end}"]) for end in "uv")
            near = likely(left, right, rows["n_u"].to_numpy(), rows["n_v"].to_numpy())
            yield batch(_PAIRS, {c: rows[c].to_numpy()[near] for c in ("u", "v")})

        return step

    return per_batch(known.select("u", "v", *[f"{c}_{end}" for c in columns for end in "uv"]), work, "u long, v long")


def _sets(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, items): the whole sets of the nodes in ``wanted`` (node, low, raw), from one text of each."""
    rows = _rows(documents).withColumnRenamed("raw", "_raw")
    same = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("_raw") == F.col("raw"))
    # Rows that repeat both are folded before anything is moved.
    texts = rows.join(wanted, same).groupBy("node").agg(F.min("text").alias("text"))

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            yield batch(_SETS, {"node": rows["node"], "items": [hash_set(t.as_py(), shingle).tobytes() for t in rows["text"]]})

        return step

    return per_batch(texts, work, "node long, items binary")


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    at = np.searchsorted(one, two)
    shared = int((one[np.minimum(at, len(one) - 1)] == two).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact similarity of a leading set, which comes first in its group, with each of the group's other sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.empty(0, np.uint64)
        for b in batches:
            found = []
            for u, v, items in zip(b["u"].to_pylist(), b["v"].to_pylist(), b["items"]):
                items = np.frombuffer(items.as_py(), np.uint64)
                if v is None:
                    leader, own = u, items
                    continue
                assert u == leader, "a group without its leading set"
                if _linked(own, items, percent):
                    found.append((u, v))
            if found:
                yield batch(_PAIRS, dict(zip("uv", zip(*found))))

    return run


def _links(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) that reach the threshold on their whole sets, stored."""
    likely = stage(_likely(pairs, nodes, percent), "likely")
    ends = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = stage(_sets(documents, nodes.select("node", "low", "raw").join(ends, "node"), shingle), "sets")
    # A text with very many partners is confirmed in several tasks, its set once in each.
    per_leader = likely.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    members = likely.join(per_leader, "u").join(sets, F.col("v") == F.col("node")).select(
        "u", F.pmod(F.hash("v"), "parts").alias("part"), "v", "items"
    )
    leaders = per_leader.join(sets, F.col("u") == F.col("node")).select(
        "u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "items"
    )
    groups = leaders.unionByName(members).repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return stage(groups.select("u", "v", "items").mapInArrow(_confirm(percent), "u long, v long"), "near-links")


def _compare_routes(percent: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the components that meet in a route, in a partition sorted by route.

    Every two texts of different components are compared in one route only, that of the first ``depth`` bands they
    share: by their registers, and the likely ones, unless they got connected meanwhile, by their whole sets.
    """

    def links(rows: pa.Table, likely: Likely) -> Iterator[tuple[int, int]]:
        rows = rows.combine_chunks()
        nodes, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        sizes, last = rows["n"].to_numpy(), rows["last"][0].as_py()
        bands = rows["bands"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        own = _own_registers(rows["bands"].chunk(0), rows["filled"].chunk(0))
        # The shingles of the route, numbered.
        items = [np.frombuffer(x.as_py(), np.uint64) for x in rows["items"].chunk(0)]
        values, numbers = np.unique(np.concatenate(items), return_inverse=True)
        numbers, mark = np.split(numbers, np.cumsum(sizes)[:-1]), np.zeros(len(values), np.int64)
        # All but the largest component, against everything.
        names, place, counts = np.unique(root, return_inverse=True, return_counts=True)
        outside = np.flatnonzero(place != counts.argmax())
        group = list(range(len(names)))

        def find(i: int) -> int:
            while group[i] != i:
                i = group[i] = group[group[i]]
            return i

        step = max(1, PAIRS_AT_ONCE // len(nodes))
        for at in range(0, len(outside), step):
            some = outside[at : at + step]
            i, j = (x.ravel() for x in np.meshgrid(some, np.arange(len(nodes)), indexing="ij"))
            # A pair of two outsiders comes once.
            mine = (place[i] != place[j]) & ((place[j] == counts.argmax()) | (i < j))
            i, j = i[mine], j[mine]
            mine = (bands[i, : last + 1] == bands[j, : last + 1]).sum(axis=1) == depth
            i, j = i[mine], j[mine]
            if not len(i):
                continue
            near = likely(own[i], own[j], sizes[i], sizes[j])
            i, j = i[near], j[near]
            for a in np.unique(i).tolist():
                mates = [b for b in j[i == a].tolist() if find(place[b]) != find(place[a])]
                if not mates:
                    continue
                # Whole sets: this text's marks, summed over the numbers of each other one.
                mark[numbers[a]] = 1
                starts = np.cumsum([0, *[len(numbers[b]) for b in mates[:-1]]])
                shared = np.add.reduceat(mark[np.concatenate([numbers[b] for b in mates])], starts)
                mark[numbers[a]] = 0
                for b in np.flatnonzero(100 * shared >= percent * (sizes[a] + sizes[mates] - shared)).tolist():
                    one, two = find(place[a]), find(place[mates[b]])
                    if one != two:
                        group[one] = two
                        yield int(nodes[a]), int(nodes[mates[b]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely, held = Likely(percent), None

        def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            route = rows["route"].to_numpy()
            cuts = [0, *(np.flatnonzero(route[1:] != route[:-1]) + 1).tolist(), len(route)]
            found = [pair for a, b in zip(cuts, cuts[1:]) for pair in links(rows.slice(a, b - a), likely)]
            if found:
                yield batch(_PAIRS, dict(zip("uv", zip(*found))))

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            # All but the last route is complete.
            complete = int(np.argmax(held["route"].to_numpy() == held["route"][-1].as_py()))
            if complete:
                yield from settled(held.slice(0, complete))
                held = held.slice(complete)
        if held is not None:
            yield from settled(held)

    return run


def _blocks_of(routes: DataFrame, limit: int) -> DataFrame:
    """Large routes as rows of block pairs of bounded size: every two members meet in one of them."""
    half = max(1, limit // 2)
    blocks = F.greatest(F.ceil(F.col("members") / half), F.ceil(F.col("bytes") * 2 / ROUTE_BYTES)).cast("int")
    own = routes.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.xxhash64("route", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return dealt.withColumn("route", pair).select(*routes.columns)


def _undecided(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (route, node, last, root, members, bytes) of the routes whose nodes are in more than one component yet."""
    sized = rows.join(nodes.select("node", "n"), "node").join(roots, "node", "left")
    rooted = stage(sized.select("route", "node", "last", F.coalesce("root", "node").alias("root"), "n"), "rooted")
    mixed = rooted.groupBy("route").agg(
        F.count("*").alias("members"), F.sum(F.col("n") * 8).alias("bytes"), F.min("root").alias("_low"), F.max("root").alias("_high")
    ).filter(F.col("_low") != F.col("_high")).select("route", "members", "bytes")
    return stage(rooted.drop("n").join(mixed, "route"), "undecided")


def _further(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Routes made longer by one further band of the node each."""
    bands = F.posexplode("bands").alias("band", "key")
    return rows.join(nodes.select("node", "bands"), "node").select("route", "node", "last", bands).filter(
        F.col("band") > F.col("last")
    ).select(F.xxhash64("route", "band", "key").alias("route"), "node", F.col("band").alias("last"))


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows): first pairs to confirm, and the stored rows (route, node, last) of routes of three nodes or more.

    A band key that only two nodes have is a pair at once. Where more share it, each is paired with the one among them
    that shares most keys with others: the text that a family of variants comes from agrees with each of them more
    often than they do with one another.
    """
    band = nodes.select("node", F.posexplode("bands").alias("last", "key")).select(
        F.xxhash64("last", "key").alias("route"), "node", "last"
    )
    routes = stage(
        band.groupBy("route").agg(F.count("*").alias("members"), F.min("node").alias("u"), F.max("node").alias("v"))
        .filter("members > 1"), "routes",
    )
    rows = stage(band.join(routes.filter("members > 2").select("route", "members"), "route"), "route-rows")
    degrees = rows.groupBy("node").agg(F.sum(F.col("members") - 1).alias("degree"))
    best = rows.join(degrees, "node").groupBy("route").agg(F.max(F.struct("degree", "node")).alias("best"))
    stars = rows.join(best, "route").select(F.col("best.node").alias("u"), F.col("node").alias("v")).filter("u != v")
    return stage(routes.filter("members = 2").select("u", "v").unionByName(stars).distinct(), "pairs"), rows.drop("members")


def _groups(documents: DataFrame, nodes: DataFrame, shingle: int, percent: int, limit: int) -> DataFrame:
    """(node, root) of connected nodes."""
    pairs, rows = _candidates(nodes)
    found = [_links(documents, nodes, pairs, shingle, percent)]
    roots = components(found[0])
    for depth in range(1, DEPTH + 1):
        undecided = _undecided(rows, nodes, roots)
        fits = (F.col("members") <= limit) & (F.col("bytes") <= ROUTE_BYTES)
        small, crowded = undecided.filter(fits), undecided.filter(~fits)
        if depth == DEPTH:
            small = small.unionByName(_blocks_of(crowded, limit))
        ends = small.select("node").distinct()
        sets = stage(_sets(documents, nodes.select("node", "low", "raw").join(ends, "node"), shingle), "sets")
        known = nodes.select("node", "n", "bands", "filled").join(sets, "node")
        whole = small.select("route", "node", "last", "root").join(known, "node").repartition("route").sortWithinPartitions("route")
        found.append(stage(whole.mapInArrow(_compare_routes(percent, depth), "u long, v long"), "near-links"))
        if depth == DEPTH or crowded.isEmpty():
            break
        rows = stage(_further(nodes, crowded), "route-rows")
    return components(reduce(DataFrame.unionByName, found))


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, limit: int = ROUTE_LIMIT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents link where 100 * intersection >= percent * union.

    Sets are the distinct shingles of the whole text in lower-cased ASCII; a text with fewer words is one shingle, a
    text without words (null, empty, blank) has the empty set and links with nothing. ``component_id`` is the smallest
    doc_id that links lead to, the document's own included, ``kept`` whether that is the document itself. Rows that
    repeat a doc_id are rows of their own; a row without doc_id connects others like any row, and its component_id is
    null, and it is kept, if no row it is connected with has a doc_id. Other columns are ignored, an empty table gives
    no rows.

    Equal sets (by a digest of 128 bits) are one node, so copies are never paired. Nodes that share a band are
    candidates; two sets at the threshold share none of 32 bands with a probability of 1e-10 (five in 1e8 at 80 %),
    and the estimate drops as many. All else is decided on whole sets of 64-bit shingle hashes. Where a band key is
    shared, each node meets a leading one first. What is then still unconnected is compared inside tasks: keys of at
    most ``limit`` nodes (and 64 MB of sets) at once, larger ones told apart by up to two further bands, and what
    shares three is dealt to tasks in pairs of blocks. So no key is collected whole, and no pair inside a component is
    tried for its own sake. Texts are read for the sketches, and again for the sets of the candidates.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100: the bands are made for such thresholds")
    drawn = stage(sketches(documents, shingle), "sketches")
    classes = drawn.filter("n > 0").groupBy("digest", "n", "bands", "filled").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("least")
    )
    nodes = stage(
        classes.select("digest", "n", "bands", "filled", F.col("least.doc_id").alias("low"), F.col("least.raw").alias("raw"),
                       F.monotonically_increasing_id().alias("node")), "nodes",
    )
    roots = _groups(documents, nodes, shingle, percent, limit)
    rooted = nodes.join(roots, "node", "left").select("digest", "low", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
    group = rooted.join(lowest, "root").select("digest", F.col("lowest").alias("component_id"))
    linked = drawn.filter("n > 0").join(group, "digest")
    # Texts without words are apart: as rows without a digest they would all meet in one task of the join.
    alone = drawn.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "n", "component_id")
    return linked.select(*columns).unionByName(alone.select(*columns)).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
