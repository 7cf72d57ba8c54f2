r"""Spelling variants: words one edit apart, found by dynamic programming along
the sorted vocabulary.

A word's distance to all words of a sorted list is computed by scanning the list
with one edit matrix, row by row along the list word.  Adjacent words share their
longest common prefix, and so the rows up to there; a range of words sharing a
prefix shares its rows.  Only the band of three cells around the diagonal can
hold a distance of one; when no cell of a prefix's last row does, the whole range
with that prefix is skipped.  ``one_edit`` does this for all words of a chunk at
once: its state is a row of the band for each (word, range of the list), and a
step goes one character down all of them.

The vocabulary is never in one place.  Two words one edit apart agree in front of
the edit and behind it, so the one of ``L`` code points shares its first or its
last ``L // 2`` with the other, of ``L`` or ``L + 1``.  So the vocabulary is sorted
forwards and backwards, dealt by that shared part and the length ``L``, and scanned
within each part.  A part of more than ``BLOCK`` words is dealt as pairs of blocks,
so a very common beginning neither meets a task whole nor loses a pair.

A word's form is its near word of the largest count, ties to the smallest, if
that is at least ``ratio`` times as frequent; forms are followed to the last one
(counts grow by ``ratio`` each step, so the number of rounds is their logarithm).

Defined cases: null and empty texts hold no words, an empty table gives an empty
one, repeated rows count each, a null document id reads as an empty string; a word
of any length is one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize

#: Words of a part that are scanned together; a larger part is dealt in pairs of blocks.
BLOCK = 4096
#: Code points of one chunk of parts, and the states that one step of the scan holds.
CHUNK = 1 << 19
STATES = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-z\x{C0}-\x{FF}]"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7,
          modulus: int = 31) -> DataFrame:
    """``(word)``: the runs of letters, lower-cased in A-Z, one row each, of at
    least ``min_length`` code points.  Where ``modulus`` divides the checksum of
    ``<id>:<run>``, the run has lost the code point at checksum modulo length."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    sums = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run"))
    return sums.select(word.alias("word")).where(F.length("word") >= min_length)


def vocabulary(found: DataFrame, min_count: int = 2) -> DataFrame:
    """``(word, n)`` of the words with at least ``min_count`` occurrences."""
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------ the sorted scan
def shared_prefixes(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each word and the one before it."""
    size = np.diff(off)
    out = np.zeros(len(size), np.int64)
    alive = np.arange(1, len(size))
    while len(alive):
        d = out[alive]
        alive = alive[(d < size[alive]) & (d < size[alive - 1])]
        d = out[alive]
        alive = alive[flat[off[alive] + d] == flat[off[alive - 1] + d]]
        out[alive] += 1
    return out


def prefix_ranges(lcp: np.ndarray, size: np.ndarray):
    """The ranges of a sorted list by their shared prefix.

    Word ``i`` is the first with its prefixes of ``lcp[i] + 1`` to ``size[i]`` code
    points; each is one range, numbered in that order.  Returns the number of
    each word's first range, each range's first word and depth, and the range
    around each that is one code point shorter."""
    n = size - lcp
    base = np.cumsum(n) - n
    first = np.repeat(np.arange(len(size)), n)
    depth = np.arange(len(first)) - np.repeat(base, n) + np.repeat(lcp, n) + 1
    # the range around a word's first one starts at the last word before it with a shorter prefix
    up = np.arange(len(size)) - 1
    while True:
        far = np.flatnonzero((up >= 0) & (lcp[np.maximum(up, 0)] >= lcp))
        if not len(far):
            break
        up[far] = up[up[far]]
    around = np.arange(len(first)) - 1
    holder = np.maximum(up, 0)
    around[base] = np.where(up >= 0, base[holder] + lcp - lcp[holder] - 1, -1)
    return base, first, depth, around


def one_edit(flat: np.ndarray, off: np.ndarray, part: np.ndarray, shared: np.ndarray, asks: np.ndarray):
    """Pairs ``(asking word, other word)`` of a sorted list at distance one.

    The words are ``flat[off[i]:off[i + 1]]``, distinct and sorted within each
    ``part`` (parts are adjacent, their words share a prefix of ``shared`` code
    points); ``asks`` are the asking words.  Each is compared with its own part."""
    size = np.diff(off)
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    lcp = shared_prefixes(flat, off)
    lcp[begins] = shared[begins] - 1
    base, first, depth, around = prefix_ranges(lcp, size)
    whole = base[begins]  # a part as a whole has no range around it
    around[whole] = -1
    order = np.argsort(around, kind="stable")
    bound = np.searchsorted(around[order], np.arange(len(first) + 1))
    char = flat[off[first] + np.maximum(depth - 1, 0)]
    ended = size[first] == depth
    outs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    r = whole[np.searchsorted(begins, asks, "right") - 1]
    # distances of the empty edit: 1, 0, 1 around the diagonal; there is no cell before the first
    todo = [(asks, r, np.where(depth[r] > 0, 1, 2).astype(np.int8), np.zeros(len(r), np.int8),
             np.ones(len(r), np.int8))]
    top = len(flat) - 1
    while todo:
        state = todo.pop()
        while len(state[0]):
            if len(state[0]) > STATES:  # bounded memory: the rest waits
                todo.append(tuple(x[STATES:] for x in state))
                state = tuple(x[:STATES] for x in state)
            q, r, a, b, c = state
            gap = size[q] - depth[r]
            last = np.where(gap == 0, b, np.where(gap == -1, a, np.where(gap == 1, c, 2)))
            hit = ended[r] & (last == 1)
            outs.append((q[hit], first[r[hit]]))
            n = bound[r + 1] - bound[r]
            q, a, b, c = (np.repeat(x, n) for x in (q, a, b, c))
            r = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bound[r], n)]
            ch, d, m, at = char[r], depth[r], size[q], off[q]

            def differs(k):
                return (k < 0) | (k >= m) | (flat[np.clip(at + k, 0, top)] != ch)  # noqa: B023

            # the next row of the band: cells d - 1, d and d + 1 of the asking word
            na = np.minimum(a + differs(d - 2), b + 1)
            nb = np.minimum(np.minimum(b + differs(d - 1), c + 1), na + 1)
            nc = np.minimum(c + differs(d), nb + 1)
            a, b, c = (np.minimum(x, 2).astype(np.int8) for x in (na, nb, nc))
            # a range none of whose cells (within the asking word) is below two is skipped
            alive = ((a < 2) & (d - 1 <= m)) | ((b < 2) & (d <= m)) | ((c < 2) & (d + 1 <= m))
            state = tuple(x[alive] for x in (q, r, a, b, c))
    pairs = [np.concatenate(x) for x in zip(*outs)]
    return pairs[0], pairs[1]


# ------------------------------------------------------------ the distributed part
def _dealt(vocab: DataFrame) -> DataFrame:
    """``(backward, size, head, part, word)``: each word in the parts where its
    partners are; a part of more than a block once per pair of blocks."""
    length = F.length("word")
    rows = vocab.select("word", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"),
                        F.explode(F.array(length, length - 1)).alias("size"))
    rows = rows.withColumn("word", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")))
    rows = rows.withColumn("head", F.substring("word", F.lit(1), F.floor(F.col("size") / 2).cast("int")))
    key = ["backward", "size", "head"]
    rows = rows.where("size > 0")
    # a part without a word of its own length, or with one word only, has no pair
    own = F.col("own") > 0
    sizes = (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"),
                                    F.sum((F.length("word") == F.col("size")).cast("long")).alias("own"))
             .where(own & (F.col("n") > 1)))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda o: F.least("mine", o) * F.col("blocks") + F.greatest("mine", o))
    dealt = rows.join(sizes, key).withColumn("blocks", blocks).withColumn("mine", mine)
    return dealt.select(*key, "mine", F.explode(others).alias("part"), "blocks", "word")


def _chunks(batches):
    """Tables of whole parts, in the order they come, and the number of each row's part."""
    held, size = [], 0
    key = ["backward", "size", "part", "head"]

    def numbered(table):
        cols = [table.column(n).to_numpy() for n in key]
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in cols])
        return np.r_[0, np.cumsum(new)]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("word").nbytes
        if size >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            of = numbered(table)
            cut = int(np.searchsorted(of, of[-1]))  # the last part may go on in the next batch
            if cut:
                yield table.slice(0, cut), of[:cut]
            held = table.slice(cut).to_batches()
            size = sum(x.column("word").nbytes for x in held)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, numbered(table)


def _scan(batches):
    """Near pairs within the parts."""
    for table, of in _chunks(batches):
        text = table.column("word").to_pylist()
        raw = [w.encode("latin-1") for w in text]
        off = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        length = table.column("size").to_numpy()
        half = length // 2
        asks = np.flatnonzero(np.diff(off) == length)
        a, b = one_edit(flat, off, of, half, asks)
        mine, blocks, part = (table.column(n).to_numpy() for n in ("mine", "blocks", "part"))
        # words of one block meet in many pairs of blocks: only their own counts
        fine = (mine[a] != mine[b]) | (part[a] == mine[a] * blocks[a] + mine[a])
        # two words of one length find each other twice
        fine &= (np.diff(off)[b] > length[a]) | (a < b)
        a, b = a[fine], b[fine]
        back = table.column("backward").to_numpy()[a]
        # a pair that shares its beginning is found forwards
        rows = np.flatnonzero(back)
        x, y = off[a + 1] - 1, off[b + 1] - 1
        for k in range(int(half[a[rows]].max(initial=0))):
            rows = rows[(k >= half[a[rows]]) | (flat[x[rows] - np.minimum(k, half[a[rows]])]
                                                == flat[y[rows] - np.minimum(k, half[a[rows]])])]
            if not len(rows):
                break
        keep = np.ones(len(a), bool)
        keep[rows] = False
        read = [w[::-1] if r else w for w, r in zip(text, table.column("backward").to_pylist())]
        yield pa.RecordBatch.from_pydict({"a": pa.array([read[i] for i in a[keep]], pa.string()),
                                          "b": pa.array([read[i] for i in b[keep]], pa.string())})


def near_pairs(vocab: DataFrame) -> DataFrame:
    """``(a, b)``: each pair of words of ``vocab(word)`` one edit apart, once.
    Words consist of code points below 256."""
    common.prepare(vocab.sparkSession)
    dealt = _dealt(vocab.select("word"))
    key = ["backward", "size", "head", "part"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "word").mapInArrow(_scan, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the end of the chain of forms."""
    ends = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps followed
        nxt = ends.select(F.col("word").alias("root"), F.col("root").alias("over"))
        step = ends.join(nxt, "root", "left").select("word", F.coalesce("over", "root").alias("root"),
                                                     F.col("over").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        ends = step.select("word", "root")
        if step.where("moved").isEmpty():
            return ends


def variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of ``vocab(word, n)``."""
    vocab = materialize(vocab, "vocabulary")
    pairs = materialize(near_pairs(vocab), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    named = both.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    # the largest count, then the smallest word: a minimum, merged before the shuffle
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("best")
    near = named.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = vocab.join(near, "word", "left")
    big = -F.col("best.m") >= F.col("n") * ratio
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(big, F.col("best.w")).alias("form"),
                                   F.when(big, -F.col("best.m")).alias("form_n")), "forms")
    return rows.join(roots(rows), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of all words of ``docs``."""
    return variants(vocabulary(words(docs, id_col, text_col)))
