r"""Embedding near-dedup by lattice hashing.

In each of ``tables`` tables a unit vector is projected at random to eight
dimensions, scaled and decoded to the nearest point of the E8 lattice: its home
cell.  It also probes the ``probes`` neighbouring cells whose centres are
closest to it.  Two vectors are compared where one is at home in a cell that
the other is at home in or probes; the cosine is then verified in double
precision.

Vectors equal in every component and label form a class that is compared once.
A pair may meet in several cells; it counts in the first only (lowest table,
then lowest cell), which both sides' cell lists tell, so no pair is ever
emitted: each cell returns, per vector, its number of links and one edge to
its component within the cell.  A cell of more than ``block`` vectors is dealt
to several tasks as pairs of blocks.

The scale follows from the number of dimensions and the threshold, so that a
pair at the threshold is on average as far apart in a table as one at cosine
0.98 in 64 dimensions.  That one meets in one table with probability 0.96, so
seven tables miss it with probability 2e-10.

Defined cases: a vector that is null, zero or holds null or non-finite
components links with nothing, nor does one with a null label or a null id;
vectors of different lengths do not link; rows that share an id are one node;
repeated vectors all link; an empty table gives no rows; extra columns do not
matter.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.llm.minhash_dedup import key_groups
from covgrid.session import materialize

TABLES = 7
PROBES = 3
#: Scale in 64 dimensions at cosine 0.98.
SCALE = 5.0
BLOCK = 4096


def shortest_vectors() -> np.ndarray:
    """The 240 steps from an E8 point to its nearest neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: the worst rounded coordinate of an
    odd one goes the other way."""
    f = np.rint(x)
    err = x - f
    worst = np.abs(err).argmax(1)
    odd = np.flatnonzero(f.sum(1) % 2)
    f[odd, worst[odd]] += np.where(err[odd, worst[odd]] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half: the closer of both nearest points."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def projection(dim: int, table: int) -> np.ndarray:
    """Random orthonormal directions of a table (fewer than eight in fewer dimensions)."""
    rng = np.random.default_rng([dim, table])
    q, _ = np.linalg.qr(rng.normal(size=(dim, min(dim, 8))))
    return np.pad(q, ((0, 0), (0, 8 - q.shape[1])))


def cell_ids(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit names of lattice points (doubled to integers)."""
    h = salt.astype(np.uint64)
    for k in range(8):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[..., k]).astype(np.int64).view(np.uint64)
    return common.mix(h)


def scale_of(dim: int, threshold: float) -> float:
    """The scale at which a pair at the threshold is about sqrt(1/8) apart."""
    return SCALE * float(np.sqrt(max(dim, 8) / 64 * 0.02 / max(1 - threshold, 1e-6)))


def cells_of(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """vectors x tables x (1 + probes) cell names: home first."""
    steps = shortest_vectors()
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        x = unit @ projection(dim, t) * scale
        home = nearest_e8(x)
        toward = (x - home) @ steps.T
        near = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        salt = common.mix(label.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                          + np.uint64(t * 4096 + dim))
        out[:, t, 0] = cell_ids(home, salt)
        out[:, t, 1:] = cell_ids(home[:, None] + steps[near], np.repeat(salt[:, None], probes, 1))
    return out


def _hash_vectors(vectors: DataFrame, tables: int, probes: int, scale: float | None, threshold: float) -> DataFrame:
    """``id, size, vec binary, cells array<long>`` of ``vectors(id, size, label, v)``."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lists = batch.column(3)
                off = np.asarray(lists.offsets)
                flat = np.asarray(lists.values, np.float64)[off[0]: off[-1]]
                dims, label = np.diff(off), np.asarray(batch.column(2), np.int64)
                off = off - off[0]
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    x = np.stack([flat[off[r]: off[r + 1]] for r in rows])
                    unit = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
                    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                    cells = cells_of(unit, label[rows], tables, probes, scale or scale_of(int(dim), threshold))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                        pa.array([v.tobytes() for v in unit], pa.binary()),
                        common.list_array([common.signed(c.ravel()) for c in cells], pa.int64())],
                        names=["id", "size", "vec", "cells"])

    return vectors.mapInArrow(run, "id long, size long, vec binary, cells array<long>")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each of ``n`` under the links ``a-b``."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _first_meeting(cells: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.uint64) -> np.ndarray:
    """For pairs of rows: is ``key`` the first cell in which they meet?"""
    x, y = cells[a], cells[b]
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.full(len(a), none)
    open_ = np.ones(len(a), bool)
    for t in range(x.shape[1]):
        lowest = np.full(len(a), none)
        for own, other in ((x, y), (y, x)):
            home = own[:, t, 0]
            met = (other[:, t] == home[:, None]).any(1)
            lowest = np.where(met, np.minimum(lowest, home), lowest)
        now = open_ & (lowest != none)
        first[now] = lowest[now]
        open_ &= ~now
    return first == key


def _linked_in_cell(key: int, part: int, blocks: int, group, threshold: float, tables: int, probes: int):
    ids, size = np.asarray(group.column("id")), np.asarray(group.column("size"))
    home, own = np.asarray(group.column("home")), np.asarray(group.column("own"))
    vec = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
    cells = np.asarray(group.column("cells").combine_chunks().flatten(), np.int64).view(np.uint64)
    cells = cells.reshape(len(ids), tables, 1 + probes)
    links, ea, eb = np.zeros(len(ids), np.int64), [], []
    for i in range(0, len(ids), 512):
        cos = vec[i: i + 512] @ vec[i:].T
        a, b = np.nonzero(cos >= threshold)
        a, b = a + i, b + i
        keep = (a < b) & (home[a] | home[b]) & (ids[a] != ids[b])
        if part // blocks != part % blocks:  # a pair of blocks: pairs across only
            keep &= own[a] != own[b]
        a, b = a[keep], b[keep]
        keep = _first_meeting(cells, a, b, np.int64(key).view(np.uint64))
        a, b = a[keep], b[keep]
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        ea.append(a)
        eb.append(b)
    root = _roots(len(ids), np.concatenate(ea), np.concatenate(eb))
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])],
                                      ["id", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float | None = None,
                    block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``id, n_links, component_id, kept``."""
    common.prepare(vectors.sparkSession)
    v = F.col("v")
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
              & F.exists(v, lambda x: x != 0))
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("v"))
    keyed = every.select("*", F.coalesce(usable, F.lit(False)).alias("usable")).select(
        "*", F.when(F.col("usable"), F.xxhash64("v", "label")).alias("c1"),
        F.when(F.col("usable"), F.xxhash64(F.lit(0x51ED27), "label", "v")).alias("c2"))
    classes = materialize(keyed.where("usable").groupBy("c1", "c2")
                          .agg(F.min("id").alias("rep"), F.count_distinct("id").alias("size")), "vector-classes")
    reps = keyed.where("usable").join(classes.select("c1", "c2", F.col("rep").alias("id"), "size"), ["c1", "c2", "id"])
    hashed = materialize(_hash_vectors(reps.select("id", "size", "label", "v"), tables, probes, scale, threshold), "cells")

    rows = hashed.select("id", F.posexplode("cells").alias("at", "key")).select(
        "id", "key", (F.col("at") % (1 + probes) == 0).alias("home"))
    found = (rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes"))
             .where("n > 1 and homes > 0").select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda o: F.least("own", o) * F.col("blocks") + F.greatest("own", o))
    dealt = (rows.join(found, "key").withColumn("own", own).withColumn("part", F.explode(parts))
             .join(hashed, "id").select("key", "part", "id", "size", "home", "own", "blocks", "vec", "cells"))

    def link(batches):
        for group in key_groups(batches, 2):
            key, part, blocks = (group.column(c)[0].as_py() for c in ("key", "part", "blocks"))
            yield _linked_in_cell(key, part, blocks, group, threshold, tables, probes)

    links = materialize(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id")
                        .mapInArrow(link, "id long, links long, root long"), "links")
    labels = common.components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    out = (keyed.select("id", "c1", "c2").join(classes, ["c1", "c2"], "left").join(degree, "rep", "left")
           .join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left"))
    component = F.coalesce("component", "rep", "id")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1
    return out.select("id", n_links.cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
