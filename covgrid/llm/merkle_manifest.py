r"""Merkle manifest of a dataset, with a membership proof for every row.

Rows are the leaves of one tree per source, in the order of their ids; three
consecutive nodes become their hash until one is left, the source's root, and the
sources' roots become the dataset's root the same way.

*Incremental witnesses.*  Nodes are appended in order to a ``Frontier`` of open
runs, one run per level.  A node that joins an open run takes the hashes of the
members before it as a partial witness, for every leaf below it; each sibling that
completes later extends the witnesses of the members before it.  A full run closes
into a node appended one level up, so a witness grows level by level.

*Blocks.*  ``3 ** BLOCK_LEVELS`` aligned leaves form a block, whichever task holds
it, and blocks are appended to independently.  The roots of a source's blocks are
again nodes in order, and so further appends, in blocks of their own, until one
root per source is left; the sources' roots follow in the same way.  A leaf's proof
is its witness within its block, then that of its block's root, and so on.  No
task holds more than a block; a source of any size is many blocks.

*Places.*  Leaves are dealt by ranges of (source, id) and written; a node's place in
its source is its place in its range plus the sizes of the source's ranges before.

Defined cases: a null source is a source of its own, before all others; null columns
hash as ``-``; equal ids are ordered by leaf hash, repeated rows are leaves of their
own; an empty table has no rows and so no root; extra columns do not count.
"""

from __future__ import annotations

from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize

ARITY = 3
#: A block holds 3 ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 6

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_BATCH = 2000


def digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of a row: each value by its length in bytes and its text, null as ``-``."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Frontier:
    """Open runs of one tree, from the lowest level up.  ``append`` takes nodes in
    order; ``close`` ends the tree at ``levels`` levels, or at its first level of one
    node.  ``witness[i]`` holds the siblings of the ``i``-th node, level by level."""

    def __init__(self):
        self.runs: list[list[tuple[str, list[int]]]] = []  # per level: (hash, leaves below)
        self.done: list[int] = []  # nodes that each level has passed on
        self.witness: list[list[str]] = []

    def append(self, node: str) -> None:
        self.witness.append([])
        self._add(0, node, [len(self.witness) - 1])

    def _add(self, level: int, node: str, leaves: list[int]) -> None:
        if level == len(self.runs):
            self.runs.append([])
            self.done.append(0)
        run = self.runs[level]
        for other, below in run:  # a later sibling extends the members before it
            for i in below:
                self.witness[i].append(node)
        before = [other for other, _ in run]
        for i in leaves:  # its own leaves begin with the members there are
            self.witness[i].extend(before)
        run.append((node, leaves))
        if len(run) == ARITY:
            self._shut(level)

    def _shut(self, level: int) -> None:
        run = self.runs[level]
        self.runs[level] = []
        self.done[level] += 1
        self._add(level + 1, digest(h for h, _ in run), [i for _, below in run for i in below])

    def close(self, levels: int | None) -> str:
        """The root.  ``levels``: of a block among others, so even a lone node is
        hashed up to there; None: of a whole tree, which ends at one node."""
        level = 0
        while level < len(self.runs):
            if levels is None:
                if not self.done[level] and len(self.runs[level]) == 1:
                    break
            elif level == levels:
                break
            if self.runs[level]:
                self._shut(level)
            level += 1
        return self.runs[level][0][0]


def _append_blocks(batches, levels: int):
    """Nodes ``(skey, total, place, node, ..)`` in order: each with its witness in its
    block, and one row per block (``root`` true) with its root."""
    size = ARITY ** levels

    def rows():
        for b in batches:
            yield from zip(*(b.column(n).to_pylist() for n in ("skey", "total", "place", "node", "tampered", "id")))

    def finished(block, frontier):
        skey, total, number = block[0][0], block[0][1], block[0][2] // size
        root = frontier.close(levels if total > size else None)
        for (k, t, place, node, tampered, id_), w in zip(block, frontier.witness):
            yield k, t, place, node, tampered, id_, w, False
        yield skey, -(-total // size), number, root, None, None, None, True

    def blocks():
        block, frontier, key = [], None, None
        for r in rows():
            if (r[0], r[2] // size) != key:
                if block:
                    yield from finished(block, frontier)
                block, frontier, key = [], Frontier(), (r[0], r[2] // size)
            block.append(r)
            frontier.append(r[3])
        if block:
            yield from finished(block, frontier)

    held = []
    for r in blocks():
        held.append(r)
        if len(held) == _BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


_NODES = pa.schema([("skey", pa.string()), ("total", pa.int64()), ("place", pa.int64()), ("node", pa.string()),
                    ("tampered", pa.string()), ("id", pa.string()), ("witness", pa.list_(pa.string())),
                    ("root", pa.bool_())])
_NODES_SQL = ("skey string, total bigint, place bigint, node string, tampered string, id string, "
              "witness array<string>, root boolean")


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)


def _numbered(batches):
    """The place of each row within its source and range; rows come in order."""
    skey, at = None, 0
    for b in batches:
        places = []
        for k in b.column("skey").to_pylist():
            at = at + 1 if k == skey else 0
            skey = k
            places.append(at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], [*b.schema.names, "near"])


def placed(nodes: DataFrame) -> DataFrame:
    """``nodes(skey, node, tampered, id, o1)`` plus ``total`` and ``place`` (from 0) in
    the order of ``o1, node`` within each ``skey``."""
    dealt = nodes.repartitionByRange("skey", "o1", "node").sortWithinPartitions("skey", "o1", "node")
    dealt = dealt.withColumn("range", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", near bigint"
    dealt = materialize(dealt.mapInArrow(_numbered, schema), "places")
    sizes = dealt.groupBy("skey", "range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("skey").orderBy("range")  # one row per source and range
    sizes = sizes.select("skey", "range", (F.sum("n").over(w) - F.col("n")).alias("before"),
                         F.sum("n").over(Window.partitionBy("skey")).alias("total"))
    return (dealt.join(sizes, ["skey", "range"])
            .select("skey", "total", (F.col("before") + F.col("near")).alias("place"), "node", "tampered", "id"))


def _levels(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes with their witnesses, then the roots of their blocks with theirs,
    and so on; the last has one node per ``skey``."""
    size = ARITY ** levels
    out = []
    while True:
        block = F.floor(F.col("place") / size).cast("long")
        dealt = (nodes.withColumn("block", block).repartition("skey", "block")
                 .sortWithinPartitions("skey", "place").drop("block"))
        both = materialize(dealt.mapInArrow(partial(_append_blocks, levels=levels), _NODES_SQL), "blocks")
        out.append(both.where("not root").drop("root"))
        nodes = both.where("root").drop("root", "witness")
        if nodes.where("total > 1").isEmpty():
            out.append(nodes.withColumn("witness", F.array().cast("array<string>")))
            return out


def _joined(tables: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Witnesses of the lowest level extended by those of all levels above.  ``top``
    holds ``(skey, root, above, path)`` of each tree's root."""
    size = ARITY ** levels
    end = tables[-1].select("skey", F.col("node").alias("subroot"))
    up = end.join(top, "skey").select("skey", F.lit(0).cast("long").alias("block"), "subroot", "top_root", "above",
                                      "path")
    for nodes in reversed(tables[:-1]):
        here = (nodes.withColumn("block", F.floor(F.col("place") / size).cast("long")).join(up, ["skey", "block"])
                .withColumn("above", F.concat("witness", "above"))
                .withColumn("path", F.concat(F.array(F.struct("place", "total")), "path")))
        up = here.select("skey", F.col("place").alias("block"), "subroot", "top_root", "above", "path")
    return here


def fold(node: str, siblings: list[str], path: list[tuple[int, int]], levels: int = BLOCK_LEVELS) -> str:
    """The root that ``node`` and its siblings lead to.  ``path``: place and size of
    each list of nodes that the proof climbs, block by block."""
    at = iter(siblings)
    for place, total in path:
        steps = levels
        whole = total <= ARITY ** levels
        while total > 1 if whole else steps:
            mine = place % ARITY
            others = min(ARITY, total - place // ARITY * ARITY) - 1
            run = [next(at) for _ in range(others)]
            node = digest([*run[:mine], node, *run[mine:]])
            place, total, steps = place // ARITY, -(-total // ARITY), steps - 1
    return node


def _verify(batches, levels: int):
    for b in batches:
        ids, leaf, tampered, subroot, root, above, path = (
            b.column(n).to_pylist() for n in ("id", "node", "tampered", "subroot", "top_root", "above", "path"))
        paths = [[(p["place"], p["total"]) for p in x] for x in path]
        folded = [fold(t if t is not None else n, w, p, levels) for n, t, w, p in zip(leaf, tampered, above, paths)]
        yield pa.RecordBatch.from_pydict({
            "id": ids, "leaf": leaf, "subroot": subroot, "root": root,
            "proof": pa.array(above, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == r for f, r in zip(folded, root)], pa.bool_())})


def manifest(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", columns: list[str] | None = None,
             suspect: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``(id string, leaf, subroot, root, proof array<string>, folded_root, verified)`` of each row.

    ``suspect`` gives other contents for some columns (where its value differs or not,
    null stays null): the leaf that is folded with the proof is made of those, as if the
    row had been changed after the manifest was made."""
    common.prepare(docs.sparkSession)
    columns = columns or COLUMNS
    plain = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_hash(list(plain.values()))
    changed = leaf_hash(list((plain | (suspect or {})).values())) if suspect else leaf
    # a null source is before all others; a prefix keeps the order of the bytes
    skey = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    nodes = docs.select(skey.alias("skey"), F.col(f"`{id_col}`").alias("o1"), leaf.alias("node"),
                        changed.alias("tampered"), F.col(f"`{id_col}`").cast("string").alias("id"))
    sources = _levels(placed(materialize(nodes, "leaves")), levels)
    roots = sources[-1].select(F.lit("").alias("skey"), F.col("skey").alias("o1"), "node",
                               F.lit(None).cast("string").alias("tampered"), F.col("skey").alias("id"))
    dataset = _levels(placed(roots), levels)
    none = F.array().cast("array<string>")
    path = F.array().cast("array<struct<place:bigint,total:bigint>>")
    start = dataset[-1].select("skey", F.col("node").alias("top_root"), none.alias("above"), path.alias("path"))
    tops = _joined(dataset, start, levels)
    tops = tops.select(F.col("id").alias("skey"), "top_root", "above", "path")
    rows = _joined(sources, materialize(tops, "tops"), levels)
    return rows.select("id", "node", "tampered", "subroot", "top_root", "above", "path").mapInArrow(
        partial(_verify, levels=levels), "id string, leaf string, subroot string, root string, proof array<string>, folded_root string, "
                                         "verified boolean")
