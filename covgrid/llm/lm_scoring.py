r"""Language-model scoring with a log-bilinear model trained by noise-contrastive
estimation.

1. Token counts over all training documents by one distributed sum: N tokens, V
   distinct ones.  A document's tokens are its words ``[^\x20\x09-\x0D]+``, A-Z
   lower-cased, and one end.  The ``head`` most frequent ones get a place.
2. The ``outputs`` most frequent tokens are outcomes of their own; every other
   token, known or not, falls into one of ``buckets`` outcomes by its ending.
   Word pairs (token, the token before it; a mark of its own stands before a
   document's first token) are counted over all training documents.  What goes on
   are sums: of (context outcome, outcome), a table of bounded size that sums up
   the whole corpus; the distinct tokens after each head token; the pairs seen
   once and twice; the most frequent pairs.
3. The dense part of the model: score(c, w) = q_c . r_w + b_w, with context and
   outcome vectors.  It is trained in numpy on the outcome pairs by
   noise-contrastive estimation against the unigram distribution: each observed
   pair is told from ``noise`` noise outcomes of its context; the sum over noise
   draws is taken in expectation, so training is deterministic.
4. A batched matrix product gives the scores of all outcomes for all contexts,
   and with their log-sum the normalised log-probabilities.  A token inside a
   bucket has the bucket's probability times (c + 0.1) / (sum of the bucket's
   c + 0.1, and 0.1 for an unknown token).  This is P0(w | context).
5. The sparse part: every observed pair of tokens (u, w), of the whole growing
   vocabulary, has a direct weight d_uw, and every context u a bias a_u, beside
   the dense score.  A discount D is taken off each observed pair's count and
   given to data drawn from P0.  For these weights, one per pair, the
   noise-contrastive optimum has a closed form whatever the noise,
   exp(score) = (max(n_uw - D, 0) + D T_u P0(w | u)) / n_u, with T_u the distinct
   tokens seen after u; so no descent is run for them.  It sums to one over all
   words.  It equals an absolutely discounted pair model that falls back to the
   dense model.  D = n1 / (n1 + 2 n2), from the pairs seen once and twice, kept
   within 0.1 and 0.9.  A context that was never seen has P0 alone.
6. Documents are scored in one pass.  The ``head`` and the ``pair_head`` most
   frequent pairs are at hand in every task.  The other pairs of every document
   meet in groups, and as those of the training documents are all among them, their
   counts, and those of tokens outside the head, are sums over a group.  Each
   document gets back one sum from a group, so neither vocabulary nor pairs have to
   fit anywhere, and the sizes of the heads change no result.

Pairs are dealt packed, a few bytes each and one row per group and batch of
documents: a pair of two places by a number that spreads evenly, whatever words are
frequent; any other pair by its token outside the head, which is rare by that.
A document is known by its place in its batch until its sums are back, so the rows
of ``docs`` must come in the same order when a lost task is run again, as rows of
files do.

Defined cases: a null or empty text is one end; documents for which
``train`` is null or false are scored, not learned from; without training
documents N = V = 0; rows are scored one by one, repeated or not; extra
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize

OUTPUTS = 1024
BUCKETS = 128
#: A token's hash holds its bucket in the lowest bits.
LOW = np.uint64(BUCKETS - 1)
END = np.uint64(0x5E4D5E4D5E4D5E4D) & ~LOW
HEAD = 1 << 17
PAIR_HEAD = 1 << 20
DIM = 32
NOISE = 16
STEPS = 150
SMOOTH = 0.1


def tokens(data: np.ndarray, bounds: np.ndarray):
    """Hash (with the ending bucket) and row of every token of a block, with the ends."""
    h, starts, ends, row = common.token_hashes(data, bounds, common.WHITE)
    n, rows = len(h), len(bounds) - 1
    low = common.LOWER[data] if len(data) else data
    last = low[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)] if n else last, 0).astype(np.uint64)
    bucket = common.mix(before * np.uint64(256) + last + np.uint64(1)) & LOW
    out, owner = np.full(n + rows, END), np.zeros(n + rows, np.int64)
    at = np.arange(n) + row
    out[at], owner[at] = (h & ~LOW) | bucket, row
    owner[common.row_slices(row, rows)[1:] + np.arange(rows)] = np.arange(rows)
    return out, owner


def before(values: np.ndarray, owner: np.ndarray, start) -> np.ndarray:
    """The value before each token; ``start`` at the start of a document."""
    c = np.full(len(values), start, values.dtype)
    same = owner[1:] == owner[:-1]
    c[1:][same] = values[:-1][same]
    return c


#: Pairs are dealt over this many groups, whatever the corpus; a task works through several at a time.
DEALT = 1 << 10
#: Bits of a place in the head, and of a row's number in its batch of documents.
PLACE, ROW = 17, 15
AT_ONCE = 1 << 20
#: Of a pair dealt by a rare token, the other one: a place in the head, marked where it is the
#: context; a hash, with the highest bit set; or nothing, where the rare token is met alone.
CONTEXT, ALONE, RARE = (np.uint64(1 << k) for k in (PLACE, PLACE + 1, 63))
_ODD = 0x2545F4914F6CDD1D | 1
_MASK = np.uint64((1 << 2 * PLACE) - 1)


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The number of a pair of places in the head, spread evenly over its bits."""
    return ((u.astype(np.uint64) << np.uint64(PLACE) | w.astype(np.uint64)) * np.uint64(_ODD)) & _MASK


def places(keys: np.ndarray):
    """The two places of ``pair_keys``."""
    k = (keys * np.uint64(pow(_ODD, -1, 1 << 64))) & _MASK
    return (k >> np.uint64(PLACE)).astype(np.int64), (k & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def binaries(values: np.ndarray, off: np.ndarray, width: int) -> pa.Array:
    """The lowest ``width`` bytes of each value, as one binary for each slice of ``off``."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)[:, :width]
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * width).astype(np.int32)),
                                                             pa.py_buffer(np.ascontiguousarray(raw))])


def values_of(column: pa.Array, width: int, kind=np.uint64):
    """The values in all ``binaries`` of a column, and how many each one held."""
    column = column.cast(pa.binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(raw) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view(kind).ravel(), np.diff(off) // width


def dealt_pairs(keys: np.ndarray) -> tuple:
    """Sorted pairs of places by group, without the bits that give the group; and the slices."""
    off = np.searchsorted(keys >> np.uint64(24), np.arange(DEALT + 1))
    return binaries(keys, off, 3), off


def dealt_loose(x: np.ndarray, y: np.ndarray) -> tuple:
    """The same of sorted pairs dealt by a rare token ``x``."""
    off = np.searchsorted(x >> np.uint64(54), np.arange(DEALT + 1))
    return [binaries(x, off, 7), binaries(y, off, 3), binaries(y >> np.uint64(24), off, 5)], off


def read_pairs(batch, group: np.ndarray):
    key, size = values_of(batch.column("key"), 3)
    return key | np.repeat(group, size) << np.uint64(24), size


def read_loose(batch, group: np.ndarray):
    x, size = values_of(batch.column("x"), 7)
    x = (x & np.uint64((1 << 54) - 1)) | np.repeat(group, size) << np.uint64(54)
    return x, values_of(batch.column("y"), 3)[0] | values_of(batch.column("z"), 5)[0] << np.uint64(24), size


def whole_groups(batches, size):
    """Batches of rows that are sorted by ``group``, put together: no group is cut, and
    ``size(batch)`` of what is yielded is about AT_ONCE, or one group's."""
    held, total = [], 0
    for batch in batches:
        group = batch.column("group").to_numpy()
        cut = np.flatnonzero(np.diff(group)) + 1
        if total >= AT_ONCE and held and group[0] != held[-1].column("group")[-1].as_py():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
        elif total >= AT_ONCE and len(cut):
            held.append(batch.slice(0, cut[0]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            batch, total, held = batch.slice(cut[0]), 0, []
        held.append(batch)
        total += size(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new row begins in sorted columns; the length is put after."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), len(new))


def count_tokens(docs: DataFrame) -> DataFrame:
    """``h, n`` of each token over ``docs(text)``."""

    def run(batches):
        held, size = [], 0

        def merged():
            h, n = (np.concatenate(x) for x in zip(*held))
            h, inv = np.unique(h, return_inverse=True)
            return h, np.bincount(inv, weights=n).astype(np.int64)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(common.signed(x)) for x in merged()], ["h", "n"])

        for batch in batches:
            for _, _, data, bounds in common.text_blocks(batch.column(0)):
                held.append(np.unique(tokens(data, bounds)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 750_000:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent tokens, sorted by hash, and which outcome each one is.
    The end is never a context; in its stead it stands for the mark before first tokens."""

    def __init__(self, h: np.ndarray, n: np.ndarray, outputs: int):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]
        rank = np.lexsort((self.h, -self.n))
        rank = np.concatenate([rank[self.h[rank] == END], rank[self.h[rank] != END]])[:outputs]
        self.outputs = len(rank)  # fewer where there are fewer tokens
        self.outcome = self.outputs + (self.h & LOW).astype(np.int64)
        self.outcome[rank] = np.arange(len(rank))  # the end first
        self.total = self.outputs + BUCKETS
        self.context = np.where(self.h == END, self.total, self.outcome)
        end = np.flatnonzero(self.h == END)
        self.start = int(end[0]) if len(end) else -1

    def context_of(self, h: np.ndarray) -> np.ndarray:
        """The outcome of contexts that are not in the head."""
        return np.where(h == END, self.total, self.outputs + (h & LOW).astype(np.int64))

    def look_up(self, h: np.ndarray):
        """(outcome, index in the head or -1) of every token."""
        outcome = self.outputs + (h & LOW).astype(np.int64)
        if not len(self.h):
            return outcome, np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return np.where(known, self.outcome[at], outcome), np.where(known, at, -1)


def split(w: np.ndarray, owner: np.ndarray, at: np.ndarray, voc: Vocabulary):
    """Of each token: its context's place; whether both have one; if not, the pair as dealt by a rare token."""
    u, ahead = before(w, owner, END), before(at, owner, voc.start)
    both = (at >= 0) & (ahead >= 0)
    v, p, q = w[~both], at[~both], ahead[~both]
    x = np.where(q >= 0, v, u[~both])
    y = np.where(q >= 0, q.astype(np.uint64) | CONTEXT, np.where(p >= 0, p.astype(np.uint64), v | RARE))
    return ahead, both, x, y


def count_pairs(docs: DataFrame, vocabulary) -> DataFrame:
    """``what, key, n``, sums over all distinct pairs of ``docs(text)``, by task: of ``cell``, its
    occurrences, with key = context * outcomes + outcome; of ``types``, the distinct tokens after
    the place ``key``; of ``seen``, the pairs seen ``key`` times, once or twice; and every
    ``pair`` of places seen more often, with its count."""

    def deal(batches):
        voc = vocabulary.value
        held, loose, size = [], [], 0

        def flush():
            keys, n = (np.concatenate(x) for x in zip(*held))
            keys, inv = np.unique(keys, return_inverse=True)
            n = np.bincount(inv, weights=n).astype(np.int64)
            x, y, m = (np.concatenate(c) for c in zip(*loose))
            order = np.lexsort((y, x))
            x, y, m = x[order], y[order], m[order]
            first = runs(x, y)[:-1]
            x, y, m = x[first], y[first], np.add.reduceat(m, first) if len(first) else m
            columns, off = dealt_loose(x, y)
            packed, at = dealt_pairs(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(DEALT, dtype=np.int32)), packed, binaries(n, at, 4), *columns, binaries(m, off, 4)],
                ["group", "key", "n", "x", "y", "z", "m"])

        for batch in batches:
            for _, _, data, bounds in common.text_blocks(batch.column(0)):
                w, owner = tokens(data, bounds)
                at = voc.look_up(w)[1]
                ahead, both, x, y = split(w, owner, at, voc)
                held.append(np.unique(pair_keys(ahead[both], at[both]), return_counts=True))
                loose.append((x, y, np.ones(len(x), np.int64)))
                size += len(held[-1][0]) + len(x)
                if size > 4_000_000:
                    yield flush()
                    held.clear()
                    loose.clear()
                    size = 0
        if held:
            yield flush()

    def add(batches):
        voc = vocabulary.value
        cells = np.zeros((voc.total + 1) * voc.total, np.int64)
        types, seen = np.zeros(len(voc.h), np.int64), np.zeros(3, np.int64)

        def rows(what, key, n):
            return pa.RecordBatch.from_arrays([pa.array([what] * len(key), pa.string()), pa.array(key, pa.int64()),
                                               pa.array(n, pa.int64())], ["what", "key", "n"])

        def count(context, outcome, n):
            cells[:] += np.bincount(context * voc.total + outcome, weights=n, minlength=len(cells)).astype(np.int64)
            seen[:] += np.bincount(n[n <= 2], minlength=3)

        for batch in whole_groups(batches, lambda b: (b.column("n").nbytes + b.column("m").nbytes) // 4):
            group = batch.column("group").to_numpy().astype(np.uint64)
            keys, inv = np.unique(read_pairs(batch, group)[0], return_inverse=True)
            n = np.bincount(inv, weights=values_of(batch.column("n"), 4)[0]).astype(np.int64)
            u, w = places(keys)
            types += np.bincount(u, minlength=len(types))
            count(voc.context[u], voc.outcome[w], n)
            often = n > 2
            yield rows("pair", common.signed(keys[often]), n[often])
            x, y, _ = read_loose(batch, group)
            m = values_of(batch.column("m"), 4, np.int64)[0]
            order = np.lexsort((y, x))
            x, y, m = x[order], y[order], m[order]
            first = runs(x, y)[:-1]
            if not len(first):
                continue
            x, y, m = x[first], y[first], np.add.reduceat(m, first)
            by_w = (y & RARE == 0) & (y & CONTEXT != 0)
            by_u, place = (y & RARE == 0) & (y & CONTEXT == 0), (y & (CONTEXT - np.uint64(1))).astype(np.int64)
            types += np.bincount(place[by_w], minlength=len(types))
            context, outcome = voc.context_of(x), voc.outputs + ((np.where(by_w, x, y)) & LOW).astype(np.int64)
            context[by_w], outcome[by_u] = voc.context[place[by_w]], voc.outcome[place[by_u]]
            count(context, outcome, m)
        at, known = np.flatnonzero(cells), np.flatnonzero(types)
        yield rows("cell", at, cells[at])
        yield rows("types", known, types[known])
        yield rows("seen", np.arange(1, 3), seen[1:])

    dealt = docs.mapInArrow(deal, "group int, key binary, n binary, x binary, y binary, z binary, m binary")
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(add, "what string, key long, n long")


def train(pairs: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int = STEPS):
    """``q, r, b`` from a contexts x outcomes table of counts, by full-batch Adam."""
    rng = np.random.default_rng(11)
    pairs = pairs.astype(np.float32)
    contexts_n, outcomes = pairs.shape
    unigram = pairs.sum(0) + SMOOTH
    unigram /= unigram.sum()
    params = [rng.normal(0, 0.1, (contexts_n, dim)).astype(np.float32), rng.normal(0, 0.1, (outcomes, dim)).astype(np.float32),
              np.log(unigram)]
    share = pairs.sum(1, keepdims=True)
    scale = 1 / np.maximum(share.sum(), 1)
    shift = np.log(noise * unigram)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        q, r, b = params
        s = q @ r.T
        s += b - shift
        np.clip(s, -30, 30, out=s)
        real = 1 / (1 + np.exp(-s))  # probability of being data, not noise
        grad = (noise * share * unigram) * real - pairs * (1 - real)
        grad *= scale
        grads = [grad @ r, grad.T @ q, grad.sum(0)]
        rate = 0.05 * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return params


def normalised(params) -> np.ndarray:
    """log10 P(outcome | context) of all contexts."""
    q, r, b = (p.astype(np.float64) for p in params)
    s = q @ r.T + b
    s -= s.max(1, keepdims=True)
    return ((s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)


_KEPT: dict = {}


def table_of(params) -> np.ndarray:
    """The worker's table of log-probabilities of a broadcast model."""
    if _KEPT.get("model") is not params:
        _KEPT.update(model=params, table=normalised(params))
    return _KEPT["table"]


class Model:
    """What scoring needs, all of bounded size (heads, vectors, masses of the buckets, discount)."""

    def __init__(self, learn: DataFrame, outputs: int, head: int, pair_head: int, dim: int, noise: int, steps: int):
        counts = materialize(count_tokens(learn), "token-counts")
        self.n, self.v = counts.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        top = common.most_frequent(counts, min(head, 1 << PLACE)).toArrow().to_pandas()  # at most `head` rows
        self.voc = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), outputs)
        sent = learn.sparkSession.sparkContext.broadcast(self.voc)
        sums = materialize(count_pairs(learn, sent), "pair-sums")

        def total(what):
            return sums.where(F.col("what") == what).groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_pandas()

        cells = total("cell")  # at most (outcomes + 1) * outcomes rows
        table = np.zeros((self.voc.total + 1) * self.voc.total)
        table[cells["key"].to_numpy(np.int64)] = cells["n"]
        self.params = train(table.reshape(self.voc.total + 1, self.voc.total), dim, noise, steps)

        # mass of each bucket: all its tokens less those with an outcome of their own
        mass = np.full(BUCKETS, SMOOTH)
        bucket = F.col("h").bitwiseAND(F.lit(int(LOW)).cast("long")).cast("int")
        for r in counts.groupBy(bucket.alias("b")).agg((F.sum("n") + SMOOTH * F.count("*")).alias("mass")).collect():
            mass[r["b"]] += r["mass"]
        own = self.voc.outcome < self.voc.outputs
        np.subtract.at(mass, (self.voc.h[own] & LOW).astype(np.int64), self.voc.n[own] + SMOOTH)
        self.mass = np.maximum(mass, SMOOTH)

        seen = dict(total("seen").itertuples(index=False))
        once, twice = seen.get(1, 0), seen.get(2, 0)
        self.discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
        types = total("types")  # at most `head` rows
        self.types = np.zeros(len(self.voc.h), np.int64)
        self.types[types["key"].to_numpy(np.int64)] = types["n"]
        often = common.most_frequent(sums.where("what = 'pair'").select("key", "n"), pair_head).toArrow().to_pandas()
        key = often["key"].to_numpy(np.int64).view(np.uint64)  # at most `pair_head` rows
        order = np.argsort(key)
        self.often, self.often_n = key[order], often["n"].to_numpy(np.int64)[order]

    def sent(self) -> tuple:
        return self.voc, self.params, self.mass, self.discount, self.types, self.often, self.often_n


class Dense:
    """P0 and the weights of the head, from a broadcast model, in a worker."""

    def __init__(self, model: tuple):
        self.voc, params, mass, self.discount, self.types, self.often, self.often_n = model
        self.table, self.mass = table_of(params), np.log10(mass)
        self.logs = np.log10(self.voc.n + SMOOTH)
        inside = self.voc.outcome >= self.voc.outputs
        self.inner = np.where(inside, self.logs - self.mass[np.where(inside, self.voc.outcome - self.voc.outputs, 0)], 0.0)

    def of_head(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P0 of places ``w``."""
        return 10.0 ** (self.table[context, self.voc.outcome[w]] + self.inner[w])

    def of_rare(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P0 of hashes ``w`` outside the head, for a count and smoothing of one."""
        bucket = (w & LOW).astype(np.int64)
        return 10.0 ** (self.table[context, self.voc.outputs + bucket] - self.mass[bucket])

    def direct(self, n: np.ndarray, u: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """log10 of the probability after places ``u``."""
        return np.log10((np.maximum(n - self.discount, 0) + self.discount * self.types[u] * p0) / self.voc.n[u])


#: What is sent of a batch of documents (a home): its pairs, dealt by group, with the row and how
#: often; a row's number has its highest bit set if it is learned from.  And one row with the sums.
ENTRIES = ("group int, home long, key binary, row binary, times binary, x binary, y binary, z binary, "
           "row2 binary, times2 binary, ids array<{kind}>, learned array<boolean>, sums array<double>")
#: What comes back: sums by row; a and b of pairs of two rare tokens, whose probability is
#: a + b * (count of w + SMOOTH), and the counts of these w.
ANSWERS = ("home long, row binary, direct binary, logs binary, more binary, row2 binary, w binary, a binary, b binary, "
           "times binary, row3 binary, w3 binary, n3 binary, ids array<{kind}>, learned array<boolean>, sums array<double>")
_OF_ROW = np.uint64((1 << ROW) - 1)


def _empty(schema: pa.Schema, n: int, given: dict) -> pa.RecordBatch:
    """A batch with the given columns; others hold empty binaries or nulls."""
    none = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return pa.RecordBatch.from_arrays(
        [given.get(f.name, binaries(*none, 1) if f.type == pa.binary() else pa.nulls(n, f.type)) for f in schema], schema=schema)


def _schema(text: str, kind: pa.DataType) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<{kind}>": pa.list_(kind),
             "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split(" ")[0], types[f.split(" ")[1]]) for f in text.split(", ")])


def ask(docs: DataFrame, sent, kind: str) -> DataFrame:
    """ENTRIES of ``docs(id, text, learned, part)``: the sums that the heads give, and the other pairs."""

    def run(batches):
        dense = Dense(sent.value)
        voc, home, held, loose, made, rows, size = dense.voc, 0, [], [], [], 0, 0

        def flush():
            part, schema = made[0][0], _schema(ENTRIES, made[0][1].type)
            z, times = np.unique(np.concatenate(held), return_counts=True)
            packed, at = dealt_pairs(z >> np.uint64(ROW + 1))
            x, y, r = (np.concatenate(c) for c in zip(*loose))
            order = np.lexsort((r, y, x))
            x, y, r = x[order], y[order], r[order]
            first = runs(x, y, r)
            columns, off = dealt_loose(x[first[:-1]], y[first[:-1]])
            name = pa.array(np.full(DEALT, part << 32 | home))
            yield _empty(schema, DEALT, dict(
                zip(("x", "y", "z"), columns), group=pa.array(np.arange(DEALT, dtype=np.int32)), home=name,
                key=packed, row=binaries(z & np.uint64((2 << ROW) - 1), at, 2),
                times=binaries(times, at, 4), row2=binaries(r[first[:-1]], off, 2), times2=binaries(np.diff(first), off, 4)))
            sums = np.concatenate([m[3] for m in made])

            def one(values):
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            yield _empty(schema, 1, {
                "group": pa.array([(part + home) % DEALT], pa.int32()), "home": name[:1],
                "ids": one(pa.concat_arrays([m[1] for m in made])), "learned": one(pa.concat_arrays([m[2] for m in made])),
                "sums": one(pa.array(sums.ravel()))})

        for batch in batches:
            for i, j, data, bounds in common.text_blocks(batch.column(1)):
                n = j - i
                if made and (rows + n > 1 << ROW or size > 2_500_000):
                    yield from flush()
                    held, loose, made, rows, size, home = [], [], [], 0, 0, home + 1
                w, owner = tokens(data, bounds)
                at = voc.look_up(w)[1]
                ahead, both, x, y = split(w, owner, at, voc)
                marked = np.arange(rows, rows + n).astype(np.uint64)
                marked |= np.uint64(1 << ROW) * batch.column(2).slice(i, n).to_numpy(zero_copy_only=False).astype(np.uint64)
                key, of = pair_keys(ahead[both], at[both]), owner[both]
                place = np.minimum(np.searchsorted(dense.often, key), max(len(dense.often) - 1, 0))
                met = (dense.often[place] == key) if len(dense.often) else np.zeros(len(key), bool)
                u, v = ahead[both][met], at[both][met]
                direct = dense.direct(dense.often_n[place[met]], u, dense.of_head(voc.context[u], v))
                held.append(key[~met] << np.uint64(ROW + 1) | marked[of[~met]])
                r = marked[owner[~both]]
                twice = y & RARE != 0  # the count of w is asked for as well
                loose.append([np.concatenate(c) for c in ((x, w[~both][twice]), (y, np.full(twice.sum(), ALONE)), (r, r[twice]))])
                size += len(held[-1]) + len(loose[-1][0])
                known = at >= 0
                made.append((batch.column(3)[0].as_py(), batch.column(0).slice(i, n), batch.column(2).slice(i, n), np.stack([
                    np.bincount(owner, minlength=n), np.bincount(owner[known], minlength=n),
                    np.bincount(owner[known], weights=dense.logs[at[known]], minlength=n),
                    np.bincount(of[met], weights=direct, minlength=n)], 1).astype(float)))
                rows += n
        if made:
            yield from flush()

    return docs.mapInArrow(run, ENTRIES.format(kind=kind))


def answer(entries: DataFrame, sent, kind: str) -> DataFrame:
    """ANSWERS to ENTRIES.  Every training document sends its pairs outside the head, so the
    counts of a pair, and those of a rare token, are the sums over the entries of its group."""

    def run(batches):
        dense = Dense(sent.value)
        voc, d = dense.voc, dense.discount

        def back(names, homes, columns):
            """Columns (name, values, width), sorted by home, as binaries of each home."""
            off = np.searchsorted(homes, np.arange(len(names) + 1))
            return {name: binaries(v, off, width) for name, v, width in columns}

        def by_row(schema, names, home, row, **sums):
            """Each document's sums."""
            row_of = home.astype(np.uint64) << np.uint64(ROW) | (row & _OF_ROW)
            code, inv = np.unique(row_of, return_inverse=True)
            got = [(k, np.bincount(inv, weights=v).astype(t), np.dtype(t).itemsize) for k, (v, t) in sums.items()]
            homes = (code >> np.uint64(ROW)).astype(np.int64)
            columns = back(names, homes, [("row", code & _OF_ROW, 2), *got])
            return _empty(schema, len(names), {"home": pa.array(names), **columns})

        for batch in whole_groups(batches, lambda b: (b.column("times").nbytes + b.column("times2").nbytes) // 4):
            schema = _schema(ANSWERS, batch.schema.field("ids").type.value_type)
            docs = batch.filter(batch.column("ids").is_valid())
            if docs.num_rows:
                yield _empty(schema, docs.num_rows, {c: docs.column(c) for c in ("home", "ids", "learned", "sums")})
            group = batch.column("group").to_numpy().astype(np.uint64)
            names, of = np.unique(batch.column("home").to_numpy(), return_inverse=True)

            key, size = read_pairs(batch, group)
            if len(key):
                home, row = np.repeat(of, size), values_of(batch.column("row"), 2)[0]
                times = values_of(batch.column("times"), 4)[0].astype(float)
                keys, inv = np.unique(key, return_inverse=True)
                n = np.bincount(inv, weights=times * (row >> np.uint64(ROW)))
                u, w = places(keys)
                direct = dense.direct(n, u, dense.of_head(voc.context[u], w))[inv]
                yield by_row(schema, names, home, row, direct=(times * direct, np.float64))

            x, y, size = read_loose(batch, group)
            if not len(x):
                continue
            home, row = np.repeat(of, size), values_of(batch.column("row2"), 2)[0]
            times = values_of(batch.column("times2"), 4)[0].astype(float)
            order = np.lexsort((y, x))
            x, y, home, row, times = x[order], y[order], home[order], row[order], times[order]
            learned = times * (row >> np.uint64(ROW))
            first = runs(x, y)
            pair = np.repeat(np.arange(len(first) - 1), np.diff(first))
            n = np.add.reduceat(learned, first[:-1])
            first_x = runs(x)
            token = np.repeat(np.arange(len(first_x) - 1), np.diff(first_x))
            rare, place = y & RARE != 0, (y & (CONTEXT - np.uint64(1))).astype(np.int64)
            after = ~rare & (y & CONTEXT != 0)  # x is the token, its context in the head
            alone = ~rare & (y & ALONE != 0)  # x is the token, its context elsewhere
            ahead = ~after & ~alone  # x is the context
            count = np.bincount(token, weights=learned * ~ahead)[token] + SMOOTH  # of x as a token
            uses = np.bincount(token, weights=learned * ahead)[token]  # of x as a context
            start = first[:-1]
            types = np.bincount(token[start], weights=(n > 0) & ahead[start])[token]
            n = n[pair]
            direct, logs = np.zeros(len(x)), np.log10(count)
            k = after
            p0 = dense.of_rare(voc.context[place[k]], x[k]) * count[k]
            direct[k] = dense.direct(n[k], place[k], p0)
            new = uses == 0  # no training document has the context
            by = np.where(new, 1.0, uses)
            weight = np.where(new, 1.0, d * types) / by
            seen = np.maximum(n - d, 0) / by
            k = ahead & ~rare
            direct[k] = np.log10(seen[k] + weight[k] * dense.of_head(voc.context_of(x[k]), place[k]))
            token = ~ahead
            yield by_row(schema, names, home, row, direct=(times * direct, np.float64),
                         logs=(np.where(token, times * logs, 0.0), np.float64),
                         more=(times * (token & (count > SMOOTH)), np.uint32))
            k = np.flatnonzero(rare)
            k = k[np.argsort(home[k], kind="stable")]
            m = np.flatnonzero(alone)
            m = m[np.argsort(home[m], kind="stable")]
            yield _empty(schema, len(names), {"home": pa.array(names), **back(names, home[k], [
                ("row2", row[k] & _OF_ROW, 2), ("w", y[k], 8), ("a", seen[k], 8),
                ("b", weight[k] * dense.of_rare(voc.context_of(x[k]), y[k]), 8), ("times", times[k].astype(np.uint32), 4)]),
                **back(names, home[m], [("row3", row[m] & _OF_ROW, 2), ("w3", x[m] | RARE, 8), ("n3", count[m], 8)])})

    return (entries.repartition("group").sortWithinPartitions("group")
            .mapInArrow(run, ANSWERS.format(kind=kind)))


def gather(answers: DataFrame, kind: str) -> DataFrame:
    """``id, learned, n_tokens, known, base, model`` of every document, from all ANSWERS of its home."""

    def finished(held):
        ids, learned, sums = None, None, None
        parts = []
        for batch in held:
            home = batch.filter(batch.column("ids").is_valid())
            if home.num_rows:
                ids, learned = home.column("ids").flatten(), home.column("learned").flatten()
                sums = home.column("sums").flatten().to_numpy().reshape(-1, 4).copy()
            parts.append([values_of(batch.column(c), np.dtype(t).itemsize, t)[0] for c, t in (
                ("row", np.uint16), ("direct", np.float64), ("row2", np.uint16), ("w", np.uint64), ("a", np.float64),
                ("b", np.float64), ("times", np.uint32), ("row3", np.uint16), ("w3", np.uint64), ("n3", np.float64))])
            row, logs, more = parts[-1][0], *(values_of(batch.column(c), np.dtype(t).itemsize, t) for c, t in (
                ("logs", np.float64), ("more", np.uint32)))
            lost = np.repeat(logs[1] > 0, values_of(batch.column("row"), 2)[1])  # rows that have logs as well
            parts[-1] += [row[lost], logs[0], more[0]]
        row, direct, row2, w, a, b, times, row3, w3, n3, rows, logs, more = (np.concatenate(c) for c in zip(*parts))
        n = len(sums)
        sums[:, 3] += np.bincount(row, weights=direct, minlength=n)
        sums[:, 2] += np.bincount(rows, weights=logs, minlength=n)
        sums[:, 1] += np.bincount(rows, weights=more, minlength=n)
        if len(w):
            hashes = np.unique(w3)  # a document and w: one number
            at, known = (r.astype(np.int64) * len(hashes) + np.searchsorted(hashes, v) for r, v in ((row2, w), (row3, w3)))
            order = np.argsort(known)
            count = n3[order][np.searchsorted(known[order], at)]
            sums[:, 3] += np.bincount(row2, weights=times * np.log10(a + b * count), minlength=n)
        return pa.RecordBatch.from_arrays(
            [ids, learned, pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)),
             pa.array(sums[:, 2]), pa.array(sums[:, 3])], ["id", "learned", "n_tokens", "known", "base", "model"])

    def run(batches):
        held = []
        for batch in batches:
            home = batch.column("home").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(home)) + 1), len(home)]
            for i, j in zip(cut, cut[1:]):
                if held and held[-1].column("home")[0].as_py() != home[i]:
                    yield finished(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield finished(held)

    return (answers.repartition("home").sortWithinPartitions("home")
            .mapInArrow(run, f"id {kind}, learned boolean, n_tokens long, known long, base double, model double"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train",
          outputs: int = OUTPUTS, head: int = HEAD, pair_head: int = PAIR_HEAD, dim: int = DIM, noise: int = NOISE,
          steps: int = STEPS) -> DataFrame:
    """One row per row of ``docs``: ``id, learned, n_tokens, n_known, train_tokens,
    base_score, score`` (log10 probabilities of the text)."""
    common.prepare(docs.sparkSession)
    model = Model(docs.where(F.col(train_col)).select(F.col(text_col).alias("text")),
                  outputs, head, pair_head, dim, noise, steps)
    sent = docs.sparkSession.sparkContext.broadcast(model.sent())
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.coalesce(F.col(train_col), F.lit(False)).alias("learned"),
                        F.spark_partition_id().cast("long").alias("part"))
    scored = gather(answer(ask(asked, sent, kind), sent, kind), kind)
    return scored.select("id", "learned", "n_tokens", F.col("known").alias("n_known"),
                         F.lit(int(model.n)).cast("long").alias("train_tokens"),
                         (F.col("base") - F.col("n_tokens")
                          * F.lit(float(np.log10(model.n + SMOOTH * (model.v + 1))))).alias("base_score"),
                         F.col("model").alias("score"))
