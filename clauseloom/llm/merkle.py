"""A Merkle manifest of a table: content-addressed records of digests, and proofs found by descending from the root.

Leaves of a source stand in the order of their doc_id. Six levels of a tree (729 nodes) are a segment: built in one
group, its digest-to-children records stored under the segment's top digest, and walked in one group again. A tree of
n leaves takes one round for each factor of 729.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import batch, require_columns, stage
from clauseloom.operators.layout import number_rows

FAN = 3
LEVELS = 6
SEGMENT = FAN**LEVELS
ROWS_AT_ONCE = 5_000
#: The tree over the subroots.
TOP = -1

NODES = "tree long, size long, rank long, digest string"
RECORDS = "segment string, digest string, children array<string>, tree long, size long, rank long"
WAYS = "tree long, rank long, digest string, path string"

_RECORDS = pa.schema([
    ("segment", pa.string()), ("digest", pa.string()), ("children", pa.list_(pa.string())),
    ("tree", pa.int64()), ("size", pa.int64()), ("rank", pa.int64()),
])
_WAYS = pa.schema([("tree", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()), ("path", pa.string())])
_PROVED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("tree", pa.int64()), ("proof_sha256", pa.string()),
                     ("folded_root", pa.string())])
PROVED = "doc_id long, leaf string, tree long, proof_sha256 string, folded_root string"


def digest_of(parts: list[str]) -> str:
    """Lowercase hex sha256 of digests as text, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def _encoded(column: F.Column) -> F.Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(documents: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, given): the leaf, and the one of the row as it may have been tampered with since.

    Tampering takes the line ends out of the texts whose doc_id, as decimal text, has an even crc32.
    """
    require_columns(documents, "doc_id", "source", "lang", "n_chars", "text")
    fields = [_encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return documents.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.concat(*fields, _encoded(F.col("text"))), 256).alias("leaf"),
        F.sha2(F.concat(*fields, _encoded(tampered)), 256).alias("given"),
    )


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """The groups of a partition that is sorted by ``keys``, row by row."""
    rows = (row for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE) for row in b.slice(at, ROWS_AT_ONCE).to_pylist())
    return groupby(rows, lambda row: tuple(row[k] for k in keys))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == ROWS_AT_ONCE:
            yield batch(schema, dict(zip(schema.names, zip(*out))))
            out = []
    if out:
        yield batch(schema, dict(zip(schema.names, zip(*out))))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments over blocks of nodes: a record per inner node, and a row for the segment's top."""

    def segments() -> Iterator[tuple]:
        for (tree, block), rows in _groups(batches, "tree", "block"):
            rows = list(rows)  # one segment
            size, level, records = rows[0]["size"], [r["digest"] for r in rows], {}
            for _ in range(min(LEVELS, height(size))):
                runs = [level[i : i + FAN] for i in range(0, len(level), FAN)]
                level = [digest_of(run) for run in runs]
                records.update(zip(level, runs))
            yield level[0], None, None, tree, -(-size // SEGMENT), block
            for digest, children in records.items():
                yield level[0], digest, children, None, None, None

    yield from _batches(segments(), _RECORDS)


def _blocks(nodes: DataFrame, *first: str) -> DataFrame:
    """Nodes of a segment together and in order."""
    dealt = nodes.withColumn("block", F.floor(F.col("rank") / SEGMENT).cast("long"))
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", *first, "rank")


def build(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(layers, stores) of the trees over ``nodes`` (tree, size, rank, digest), from the leaves up.

    Layer 0 is ``nodes``; the last layer has one node, its root, for each tree. Store k holds the records between the
    layers k and k + 1 under the top digest of their segment, each segment once, whatever the places that have it.
    """
    layers, stores = [nodes], []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while not stores or most > 1:
        made = stage(_blocks(layers[-1].select("tree", "size", "rank", "digest")).mapInArrow(_build, RECORDS), "segments")
        layers.append(made.filter(F.col("tree").isNotNull()).select("tree", "size", "rank", F.col("segment").alias("digest")))
        stores.append(made.filter(F.col("tree").isNull()).select("segment", "digest", "children").dropDuplicates(["segment", "digest"]))
        most = -(-most // SEGMENT)
    return layers, stores


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Requests of a block descend from its top by the digits of their rank and collect what they do not select.

    A group holds the block's records, then the way from the root to its top, then the requests. A way lists, from
    the root down, the digit of the child that was taken and its siblings.
    """
    for (tree, block), rows in _groups(batches, "tree", "block"):
        records, top, above = {}, None, ()
        for row in rows:
            if row["kind"] == 0:
                records[row["digest"]] = row["children"]
            elif row["kind"] == 1:
                top, above = row["digest"], tuple(row["path"].split(",")) if row["path"] else ()
            else:
                at, place, path = top, row["rank"] - block * SEGMENT, list(above)
                for level in reversed(range(min(LEVELS, height(row["size"])))):
                    children = records[at]
                    digit = place // FAN**level % FAN
                    path.append(f"{digit}:{''.join(children[:digit] + children[digit + 1 :])}")
                    at = children[digit]
                if at != row["digest"]:
                    raise ValueError(f"the records lead to another digest than that of row {row['rank']} of tree {tree}")
                yield tree, row["rank"], at, path, row["doc_id"], row["given"]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way to every request."""
    ways = ((tree, rank, digest, ",".join(path)) for tree, rank, digest, path, _, _ in _reached(batches))
    yield from _batches(ways, _WAYS)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reverse the way to each request, hash its siblings, and fold the given leaf up to a root."""

    def proved() -> Iterator[tuple]:
        for tree, _, leaf, path, doc_id, given in _reached(batches):
            siblings, now = [], given
            for step in reversed(path):
                digit, others = step.split(":")
                cut = 64 * int(digit)
                siblings.append(others)
                now = digest_of([others[:cut], now, others[cut:]])
            yield doc_id, leaf, tree, digest_of(siblings), now

    yield from _batches(proved(), _PROVED)


def _requests(front: DataFrame, layer: DataFrame, store: DataFrame) -> DataFrame:
    """Per block of ``layer`` its records, the way to its top (from ``front``) and its nodes, sorted for ``_reached``."""
    none = {"doc_id": "long", "given": "string", "path": "string", "size": "long", "rank": "long", "children": "array<string>"}
    columns = ["tree", "block", "kind", "rank", "size", "digest", "children", "path", "doc_id", "given"]

    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("kind", F.lit(kind)).withColumns(
            {c: F.lit(None).cast(t) for c, t in none.items() if c not in df.columns}
        ).select(*columns)

    heads = front.select("tree", F.col("rank").alias("block"), F.col("digest").alias("segment"), "path")
    known = heads.drop("path").join(store, "segment").select("tree", "block", "digest", "children")
    asked = layer.withColumn("block", F.floor(F.col("rank") / SEGMENT).cast("long"))
    every = rows(known, 0).unionByName(rows(heads.withColumnRenamed("segment", "digest"), 1)).unionByName(rows(asked, 2))
    return every.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "rank")


def descend(tops: DataFrame, layers: list[DataFrame], stores: list[DataFrame]) -> DataFrame:
    """The requests of layer 0, sorted for ``_reached``, after all layers above it have been walked.

    ``tops`` (tree, rank 0, digest, path) are the roots with the way that led to them.
    """
    front = tops
    for layer, store in zip(layers[-2:0:-1], stores[:0:-1]):
        front = stage(_requests(front, layer, store).mapInArrow(_walk, WAYS), "ways")
    return _requests(front, layers[0], stores[0])


def manifest(documents: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame, list[DataFrame], list[DataFrame]]:
    """(layers and stores of the trees of all sources, the root, layers and stores of the tree above them)."""
    drawn = stage(leaves(documents), "leaves")
    numbered = number_rows(drawn, ["source", "doc_id", "leaf", "given"], "number")
    sources = stage(numbered.groupBy("source").agg(F.min("number").alias("first"), F.count("*").alias("size")), "sources")
    trees = stage(number_rows(sources, ["source"], "tree").withColumn("tree", F.col("tree") - 1), "trees")
    places = numbered.withColumnRenamed("source", "_source").join(trees, F.col("_source").eqNullSafe(F.col("source")))
    nodes = stage(
        places.select("tree", "size", (F.col("number") - F.col("first")).alias("rank"), F.col("leaf").alias("digest"), "doc_id", "given"),
        "places",
    )
    layers, stores = build(nodes)
    subroots = layers[-1].select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("size"),
                                 F.col("tree").alias("rank"), "digest")
    top_layers, top_stores = build(subroots)
    return layers, stores, top_layers[-1].select("tree", "rank", "digest"), top_layers, top_stores


def proofs(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``documents``.

    A leaf is the sha256 of doc_id, source, lang, n_chars and text, each `-` if null, else its UTF-8 byte count, `:`
    and itself. Per source, three neighbouring nodes become the digest of their digests until one, the subroot, is
    left; subroots ordered by source (null first, by UTF-8 bytes) become the root in the same way. ``proof_sha256``
    digests the siblings from the leaf up; ``folded_root`` is what they and the leaf of the row as tampered with lead
    to, and ``verified`` whether that is the root.

    Rows without doc_id stand before the others of their source; rows that repeat a doc_id stand by their leaf, and
    rows alike in all have a place each. A null source is a source of its own, an empty text is not a null one. Further
    columns are ignored, an empty table gives no rows.

    No source passes through one task: rows are numbered by ranges, and blocks of 729 are built and walked in groups.
    Requests of a block descend together, so what is moved per level is a record per node, not a way per leaf.
    """
    layers, stores, root, top_layers, top_stores = manifest(documents)
    subroot_requests = descend(root.withColumn("path", F.lit("")), top_layers, top_stores)
    subroots = stage(subroot_requests.mapInArrow(_walk, WAYS), "subroots")
    tops = subroots.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", "path")
    requests = descend(tops, layers, stores)
    subroot = subroots.select(F.col("rank").alias("tree"), F.col("digest").alias("subroot"))
    return requests.mapInArrow(_prove, PROVED).join(subroot, "tree").select(
        "doc_id", "leaf", "subroot", root.agg(F.max("digest")).scalar().alias("root"), "proof_sha256", "folded_root"
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
