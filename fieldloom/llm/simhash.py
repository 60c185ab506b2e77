"""Near-duplicates by SimHash, with exact pairs from vantage-point trees.

A vantage-point tree splits fingerprints by their Hamming distance to a vantage point: up to a threshold to the left,
the others to the right. A fingerprint that asks for all others within `radius` must visit the left side if its own
distance is up to threshold + radius, and the right side if it is over threshold - radius (triangle bounds). Distances
between unrelated fingerprints lie close together, so with all 64 bits a radius of 3 prunes little. But two fingerprints
that differ in at most 3 bits differ in at most 1 bit of one of their halves. So there are two trees, each measuring one
half, with radius 1; what they bring together is checked on all 64 bits. A node that its half can't split (many
fingerprints with the same half) measures all bits with radius 3 instead. No pair is lost.

The upper part of each tree is fitted on a bounded sample and makes the shards: each distinct fingerprint lives in one
shard of each tree and asks in all that overlap its radius. Each shard continues the tree over all its fingerprints;
a shard too crowded for one task is cut into cells, in which each two of its parts meet.
A shard gives back a forest that links what it found, no more rows than it has, and the forests are joined to
components by Spark.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.session import materialize

#: Bits in which linked fingerprints may differ.
NEAR = 3
#: Words of a shingle and the hash's seed.
SHINGLE, SEED = 3, 42
#: Fingerprints to fit the upper trees on; 8 bytes each on the driver.
SAMPLE = 1 << 16
#: Distinct fingerprints that live in a shard, and in a leaf of a shard's own tree.
SHARD_ROWS, LEAF_ROWS = 1 << 14, 96
HALVES = [np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)]
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a shard that one task takes; a shard that no vantage point splits may have more, and is cut into cells.
CELL_ROWS = 1 << 19
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(text: str | None) -> int:
    """The SimHash of a text; 0 for null and texts without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint) and the columns `also`, the fingerprint as a signed 64-bit integer."""

    def each(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fingerprint", *also])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("_text"), *also)
    schema = ["doc_id long", "fingerprint long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[2:])]
    return texts.mapInArrow(each, ", ".join(schema))


class Node(NamedTuple):
    """A leaf has no vantage point."""

    leaf: int
    mask: np.uint64 = WHOLE
    radius: int = NEAR
    vantage: np.uint64 = np.uint64(0)
    threshold: int = 0
    near: Node | None = None
    far: Node | None = None


def _split(points: np.ndarray, mask: np.uint64, radius: int) -> tuple[float, np.uint64, int]:
    """Of a few vantage points the one and the threshold that leave the least work, as a share of all pairs."""
    best = (1.0, points[0], 0)
    for vantage in points[:: max(1, len(points) // 4)][:5]:
        counts = np.bincount(np.bitwise_count((points ^ vantage) & mask), minlength=65)
        below = np.concatenate([np.zeros(1 + radius), np.cumsum(counts), np.full(radius, len(points))]) / len(points)
        inside, wide, narrow = below[1 + radius : 66 + radius], below[1 + 2 * radius : 66 + 2 * radius], below[1:66]
        work = inside * wide + (1 - inside) * (1 - narrow)
        at = int(np.argmin(work))
        best = min(best, (float(work[at]), vantage, at), key=lambda x: x[0])
    return best


def grow(points: np.ndarray, half: np.uint64, leaf_rows: float) -> tuple[Node, int]:
    """A tree over distinct fingerprints whose leaves have up to `leaf_rows` of them, where that can be; its leaves."""
    leaves = 0

    def below(points: np.ndarray) -> Node:
        nonlocal leaves
        if len(points) > leaf_rows:
            for mask, radius in ((half, 1), (WHOLE, NEAR)):
                work, vantage, threshold = _split(points, mask, radius)
                if work < 0.85:
                    near = np.bitwise_count((points ^ vantage) & mask) <= threshold
                    return Node(-1, mask, radius, vantage, threshold, below(points[near]), below(points[~near]))
        leaves += 1
        return Node(leaves - 1)

    return below(points), leaves


def route(tree: Node, points: np.ndarray, ask: bool):
    """(leaf, indices of points): where points live, or with `ask` all leaves that overlap their radius."""
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node.near is None:
            yield node.leaf, at
            continue
        distance = np.bitwise_count((points[at] ^ node.vantage) & node.mask).astype(np.int16)
        reach = node.radius if ask else 0
        stack.append((node.near, at[distance <= node.threshold + reach]))
        stack.append((node.far, at[distance > node.threshold - reach]))


def forest(points: np.ndarray, home: np.ndarray, half: np.uint64) -> np.ndarray:
    """The smallest point, as an index, that each point of a shard is linked to. Points are distinct and in order."""
    root = np.arange(len(points))
    living = np.flatnonzero(home)
    if not len(living):
        return root
    tree, leaves = grow(points[living], half, LEAF_ROWS)
    lives = {leaf: living[at] for leaf, at in route(tree, points[living], False)}
    for leaf, asking in route(tree, points, True):
        here = lives.get(leaf)
        if here is None:
            continue
        for at in range(0, len(asking), 4096):
            for to in range(0, len(here), 4096):
                a, b = asking[at : at + 4096], here[to : to + 4096]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= NEAR)
                _link(root, a[x], b[y])
    return root


def _link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i] for all i; afterwards every root is flat."""
    a, b = a[a != b], b[a != b]
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := root[root], root):
            root[:] = above


def near_links(distinct: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within NEAR bits of each other; `distinct` has `rows` rows of them."""
    part = min(1.0, SAMPLE / max(1, rows))
    scale = 1 << 30
    sampled = distinct.where(F.pmod(F.xxhash64(F.col("fingerprint"), F.lit("sample")), F.lit(scale)) < int(part * scale)).select("fingerprint")
    sample = np.sort(np.array([r[0] for r in sampled.collect()], np.int64)).view(np.uint64)
    leaf_rows = max(16.0, SHARD_ROWS * len(sample) / max(1, rows))
    trees = [grow(sample, half, leaf_rows)[0] if len(sample) else Node(0) for half in HALVES]

    def shards(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, tree in enumerate(trees):
                home = np.full(len(points), -1)
                for leaf, at in route(tree, points, False):
                    home[at] = leaf
                for leaf, at in route(tree, points, True):
                    columns = [np.full(len(at), number, np.int32), np.full(len(at), leaf, np.int32), points[at].view(np.int64), home[at] == leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "leaf", "fingerprint", "home"])

    def links(key, rows):
        points = rows["fingerprint"].to_numpy().view(np.uint64)
        order = np.argsort(points, kind="stable")
        points, home = points[order], rows["home"].to_numpy()[order]
        root = forest(points, home, HALVES[key[0]])
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": points[moved].view(np.int64), "b": points[root[moved]].view(np.int64)})

    routed = materialize(distinct.select("fingerprint").mapInArrow(shards, "tree int, leaf int, fingerprint long, home boolean"), "routed")
    return cells(routed).groupBy("tree", "leaf", "_lives", "_asks").applyInPandas(links, "a long, b long")


def cells(routed: DataFrame) -> DataFrame:
    """Shards of over CELL_ROWS rows cut into parts by hash, and each pair of parts made a cell of its own.

    In the cell (_lives, _asks) the fingerprints that live in the one part meet those of the other, so all meet.
    """
    # At most one row per leaf of the upper trees, whose number SAMPLE bounds.
    crowded = routed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_parts")).where("_parts > 1")
    parted = routed.join(F.broadcast(crowded), ["tree", "leaf"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    parted = parted.withColumn("_part", F.pmod(F.xxhash64("fingerprint", F.lit("part")), F.col("_parts")).cast("int"))
    asks = "transform(sequence(0, _parts - 1), i -> struct(i AS _lives, _part AS _asks, home AND i = _part AS _home))"
    lives = "transform(filter(sequence(0, _parts - 1), j -> home AND j != _part), j -> struct(_part AS _lives, j AS _asks, true AS _home))"
    placed = parted.select("tree", "leaf", "fingerprint", F.explode(F.expr(f"concat({asks}, {lives})")).alias("_cell"))
    return placed.select("tree", "leaf", "_cell._lives", "_cell._asks", "fingerprint", F.col("_cell._home").alias("home"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (signed 64-bit), component_id, and the columns `also`.

    component_id is the smallest doc_id that links reach; documents of equal fingerprint are linked too, also the empty
    ones. Repeated rows are documents like any other; null ids get their component's id and are never the smallest,
    so a component of null ids only has a null id. An empty table gives no rows. Other columns are not read.
    """
    marked = materialize(fingerprints(docs, id_column, text_column, also), "fingerprints")
    distinct = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("_doc")), "distinct")
    found = components(near_links(distinct, distinct.count()))
    rooted = distinct.join(found, distinct.fingerprint == found.node, "left").select(
        "fingerprint", "_doc", F.coalesce("root", "fingerprint").alias("_root")
    )
    least = rooted.groupBy(F.col("_root").alias("_group")).agg(F.min("_doc").alias("component_id"))
    named = rooted.join(least, F.col("_root") == F.col("_group")).select(F.col("fingerprint").alias("_f"), "component_id")
    return marked.join(named, marked.fingerprint == F.col("_f"), "left").select("doc_id", "fingerprint", "component_id", *also)
