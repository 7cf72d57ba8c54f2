r"""MinHash near-dedup with sequential Bayesian verification.

1. One pass makes, per document, the set of word shingles (64-bit hashes), a
   128-bit digest of the set, ``hashes`` MinHash values (one byte each kept as
   the signature) and ``bands`` band keys of ``band_rows`` values each.
2. Documents of equal digest form a class; its smallest document id stands for
   it from here on, so thousands of copies are one row.
3. Representatives that share a band key are candidates.  Each bucket is
   compared signature batch by signature batch: with ``m`` of ``n`` positions
   equal, a uniform prior gives P(similarity >= t) = P(Bin(n+1, t) <= m); a
   pair is pruned once that falls below ``miss``.  Of the surviving pairs a
   bucket emits a spanning forest of largest estimated similarity: linear in
   the bucket, never all pairs.
4. Forest pairs are verified on the full sets; true links are contracted to
   components.
5. Where a bucket still holds several components, its members get a longer
   signature (``more_hashes``), the comparison goes on over it, and the pairs
   between different components that survive are verified as well.  So every
   surviving candidate pair is either verified or joins two documents already
   in one component.

A bucket of more than ``block`` members is dealt to several tasks as pairs of
blocks, with the same result.

Defined cases: words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a document
of fewer words than ``k`` has one shingle, its whole sequence; without words
(or with a null text) it has none and links with nothing; rows that share a
document id are one node; a null id links with nothing; an empty table gives
no rows; extra columns do not matter.
"""

from __future__ import annotations

from functools import cache
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize

HASHES = 256
BATCH = 32
#: Signature positions of the second look at buckets that hold several components.
MORE_HASHES = 1024
BLOCK = 4096
MISS = 1e-5


def tune_bands(similarity: float, hashes: int, recall: float) -> tuple[int, int]:
    """(bands, rows): the most selective banding that collides a pair of the
    given similarity with at least the given probability."""
    for rows in range(12, 0, -1):
        need = int(np.ceil(np.log1p(-recall) / np.log1p(-similarity ** rows)))
        if need * rows <= hashes:
            return need, rows
    return hashes, 1


@cache
def least_matches(similarity: float, hashes: int, batch: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(positions compared, fewest equal positions that survive), batch by batch."""
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            ways = lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m)
            tail += exp(ways + m * log(similarity) + (n + 1 - m) * log1p(-similarity))
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def _seeds(hashes: int):
    """Odd multipliers and offsets; a longer list begins with the shorter one."""
    ab = np.random.default_rng(20240229).integers(0, 1 << 32, (hashes, 2), dtype=np.uint64).astype(np.uint32)
    return ab[:, 0] | np.uint32(1), ab[:, 1].copy()


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit MinHash values of one set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i: i + 1024] * a + b).min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = values[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[:, j]
    return common.mix(h)


def shingle_sets(column: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text of a column."""
    for i, j, data, bounds in common.text_blocks(column):
        h, _, _, row = common.token_hashes(data, bounds, common.WHITE)
        cut = common.row_slices(row, j - i)
        for r in range(j - i):
            yield np.unique(common.shingle_hashes(h[cut[r]: cut[r + 1]], k))


def signatures(docs: DataFrame, k: int, hashes: int, bands: int, rows: int) -> DataFrame:
    """``id, n_shingles, d1, d2, bands array<long>, sig binary`` of ``docs(id, text)``."""
    a, b = _seeds(hashes)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            at = 0
            out = []

            def flush(start, out):
                return pa.RecordBatch.from_arrays([
                    ids.slice(start, len(out)), pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
                    common.list_array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.binary())],
                    names=["id", "n_shingles", "d1", "d2", "bands", "sig"])

            none = np.zeros(0, np.int64)
            for s in shingle_sets(batch.column(1), k):
                if len(s):
                    v = minhash(s, a, b)
                    d1 = int(common.mix(s * np.uint64(0xA0761D6478BD642F)).sum().view(np.int64))
                    d2 = int(common.mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum().view(np.int64))
                    out.append((len(s), d1, d2, common.signed(band_keys(v, bands, rows)),
                                v.astype(np.uint8).tobytes()))
                else:
                    out.append((0, 0, 0, none, b""))
                if len(out) == 2000:
                    yield flush(at, out)
                    at, out = at + len(out), []
            if out:
                yield flush(at, out)

    return docs.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")


def long_signatures(docs: DataFrame, ids: DataFrame, k: int, hashes: int, bands: int, rows: int) -> DataFrame:
    """``id, sig, keys`` of the ``docs(id, text)`` of ``ids``: a signature of ``hashes``
    positions, which begins with the shorter one, and the band keys."""
    a, b = _seeds(hashes)

    def run(batches):
        for batch in batches:
            ids, at, out = batch.column(0), 0, []

            def flush(start, out):
                return pa.RecordBatch.from_arrays([ids.slice(start, len(out)), pa.array([o[0] for o in out], pa.binary()),
                                                   pa.array([o[1] for o in out], pa.binary())], ["id", "sig", "keys"])

            for s in shingle_sets(batch.column(1), k):
                v = minhash(s, a, b)
                out.append((v.astype(np.uint8).tobytes(), band_keys(v, bands, rows).tobytes()))
                if len(out) == 2000:
                    yield flush(at, out)
                    at, out = at + len(out), []
            if out:
                yield flush(at, out)

    return common.made_of_chosen(docs, ids, run, "id long, sig binary, keys binary")


def key_groups(batches, keys: int):
    """Groups of consecutive rows that agree in the first ``keys`` columns, from
    sorted Arrow batches: tables of one group each."""
    held = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        cuts = [*np.flatnonzero(change), batch.num_rows]
        at = 0
        for c in cuts:
            if c == 0:  # a new group begins with this batch
                if held:
                    yield pa.Table.from_batches(held)
                held = []
                continue
            held.append(batch.slice(at, c - at))
            if c < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = c
    if held:
        yield pa.Table.from_batches(held)


def survivors(sig: np.ndarray, one: np.ndarray, rows: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``rows`` survive the comparison with signature ``one``, and their
    equal positions."""
    same = np.zeros(len(rows), np.int32)
    at = 0
    for n, least in steps:
        same += (sig[rows, at:n] == one[at:n]).sum(axis=1, dtype=np.int32)
        keep = same >= least
        if not keep.all():
            rows, same = rows[keep], same[keep]
            if not len(rows):
                break
        at = n
    return rows, same


def forest(sig: np.ndarray, steps) -> list[tuple[int, int]]:
    """Spanning forest of largest similarity over the surviving pairs (Prim)."""
    n = len(sig)
    best, parent = np.full(n, -1, np.int32), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    edges, cur = [], 0
    for _ in range(n - 1):
        left[cur] = False
        rows, same = survivors(sig, sig[cur], np.flatnonzero(left), steps)
        better = same > best[rows]
        best[rows[better]], parent[rows[better]] = same[better], cur
        cur = int(np.where(left, best, -2).argmax())
        if best[cur] >= 0:
            edges.append((int(parent[cur]), cur))
    return edges


def crossing(sig: np.ndarray, keys: np.ndarray, label: np.ndarray, key: np.uint64, steps) -> list[tuple[int, int]]:
    """Surviving pairs between different labels, each in the first bucket only that
    both members share."""
    order = np.argsort(label, kind="stable")
    out = []
    for i, cur in enumerate(order):
        rest = order[i + 1:]
        rest = rest[label[rest] != label[cur]]
        if len(rest):
            rows, _ = survivors(sig, sig[cur], rest, steps)
            same = keys[rows] == keys[cur]
            rows = rows[keys[cur][same.argmax(axis=1)] == key]
            out += [(int(cur), int(r)) for r in rows]
    return out


def dealt(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Members of each bucket in groups ``(key, part)`` of bounded size: a bucket
    of up to ``block`` members is one group, a larger one a group per pair of
    blocks."""
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    parts = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")),
                    lambda o: F.least("own", o) * F.col("blocks") + F.greatest("own", o)))
    return (members.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", own)
            .withColumn("part", F.explode(parts)).drop("size", "blocks", "own"))


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` with 100 * intersection >= percent * union on the full sets."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")

    def sets(batches):
        for batch in batches:
            ids, out, at, size = batch.column(0), [], 0, 0
            for s in shingle_sets(batch.column(1), k):
                out.append(s.tobytes())
                size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(out)), pa.array(out, pa.binary())], ["id", "s"])
                    at, out, size = at + len(out), [], 0
            if out:
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(out)), pa.array(out, pa.binary())], ["id", "s"])

    full = materialize(common.made_of_chosen(docs, ids, sets, "id long, s binary"), "sets")

    def test(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                common_n = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common_n >= percent * (len(x) + len(y) - common_n) and common_n > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
              .join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
              .select("a", "b", "sa", "sb"))
    return joined.mapInArrow(test, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                    hashes: int = HASHES, more_hashes: int = MORE_HASHES, recall: float = 0.9999, miss: float = MISS,
                    block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    common.prepare(spark)
    t = percent / 100
    bands, rows = tune_bands(t, hashes // 2, recall)
    steps = least_matches(t, hashes, BATCH, miss)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = materialize(signatures(docs, k, hashes, bands, rows), "signatures")
    real = sigs.where("id is not null and n_shingles > 0")
    classes = materialize(real.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    reps = real.join(classes.select("d1", "d2", F.col("rep").alias("id")).distinct(), ["d1", "d2", "id"], "left_semi")

    rows_of = reps.select("id", F.explode(F.array_distinct("bands")).alias("key"))
    sizes = (rows_of.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"))
             .where("lo < hi").select("key", "size"))
    sizes = materialize(sizes, "buckets")
    members = materialize(rows_of.join(sizes.select("key"), "key", "left_semi").distinct(), "members")
    grouped = (dealt(members, sizes, block).join(reps.select("id", "sig"), "id").select("key", "part", "id", "sig"))

    def matrix(group, column, kind):
        return np.frombuffer(b"".join(group.column(column).to_pylist()), kind).reshape(group.num_rows, -1)

    def edges_of(ids, pairs):
        p = np.array(pairs, np.int64).reshape(-1, 2)
        x, y = ids[p[:, 0]], ids[p[:, 1]]
        keep = x != y
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], ["a", "b"])

    def forests(batches):
        for group in key_groups(batches, 2):
            yield edges_of(np.asarray(group.column("id")), forest(matrix(group, "sig", np.uint8), steps))

    def crossings(batches):
        for group in key_groups(batches, 2):
            pairs = crossing(matrix(group, "sig", np.uint8), matrix(group, "keys", np.uint64),
                             np.asarray(group.column("label")), np.int64(group.column("key")[0].as_py()).view(np.uint64),
                             finer_steps)
            yield edges_of(np.asarray(group.column("id")), pairs)

    def in_groups(df, *order):
        return df.repartition("key", "part").sortWithinPartitions("key", "part", *order)

    tested = materialize(in_groups(grouped, "id").mapInArrow(forests, "a long, b long").distinct(), "pairs")
    links = materialize(verified(tested, docs, k, percent), "links")
    labels = common.components(links)

    # buckets that still hold several components
    named = (members.join(labels.select("id", F.col("component").alias("label")), "id", "left")
             .withColumn("label", F.coalesce("label", "id")))
    mixed = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
             .where("lo < hi").select("key", "size"))
    mixed = materialize(mixed, "mixed")
    open_ids = materialize(named.join(mixed.select("key"), "key", "left_semi").select("id").distinct(), "ids")
    finer = materialize(long_signatures(docs, open_ids, k, more_hashes, bands, rows), "signatures")
    finer_steps = least_matches(t, more_hashes, BATCH, miss)
    open_rows = (dealt(named, mixed, block).join(finer, "id")
                 .select("key", "part", "id", "sig", "keys", "label"))
    more = (in_groups(open_rows, "id").mapInArrow(crossings, "a long, b long").distinct()
            .join(tested, ["a", "b"], "left_anti"))
    more = materialize(more, "pairs")
    if not more.isEmpty():
        links = links.union(verified(more, docs, k, percent))
        labels = common.components(links)

    found = (sigs.select("id", "n_shingles", "d1", "d2")
             .join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
             .join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left"))
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("id")).otherwise(
        F.coalesce("component", "rep"))
    return found.select("id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
