r"""Byte-level BPE as a monoid: texts are encoded by a tree reduction.

A text is cut in halves until they are short; the leaves are encoded each for
itself, and neighbours are joined up the tree.  Two things cross a cut:

* *Pieces* (matches of the vocabulary's pattern, which covers every character).
  The pattern looks at most two characters past a match, so a piece of the left
  side is settled when two more characters of that side follow it.  The others
  are matched again together with the first pieces of the right side, and that
  window grows until a settled match ends where a piece of the right side
  starts: from there on the right side's own pieces are those of the joined text.
* *Tokens* inside a piece that a cut divides.  A row of tokens is the encoding
  of its bytes exactly if each adjacent pair is the encoding of its own bytes: as
  long as no merge crosses a border, the merges on both sides of it are those
  of the sides alone, so the first merge that crosses one also happens in the
  pair around that border.  So the tokens around the cut are encoded again in a
  window that grows until the pairs at both its ends hold.

Decoding concatenates the tokens' bytes up the same tree.

``LOOK_AHEAD`` states how far past a match the pattern looks; a pattern that
looks farther needs a larger one.

Texts over ``SEGMENT`` characters are encoded in segments spread over all tasks
and joined per text.  Everything held at once is bounded by one such text.

Defined cases: a null text is an empty one and has no ids; repeated rows give
repeated results; an empty table gives an empty one; unknown or null ids decode
to nothing; extra columns are kept, one named like the result is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common

#: Characters of a leaf of the tree over a text, bytes of one over a piece.
LEAF_CHARS = 4096
LEAF_BYTES = 32
#: A longer text is spread over several tasks.
SEGMENT = 1 << 20
#: Pieces whose tokens a Python worker remembers in each of two generations, and their greatest length.
REMEMBERED = 150_000
REMEMBERED_CHARS = 64
#: Characters past a match that its choice may depend on.
LOOK_AHEAD = 2

NO_RANK = 1 << 60


class Vocabulary:
    """Ranks of byte strings and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS,
                 leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.firm: dict[tuple[int, int], bool] = {}

    # ------------------------------------------------------------- one piece
    def merge(self, data: bytes) -> list[int]:
        """Tokens of ``data``: the pair of lowest rank is merged, the leftmost first."""
        return self._merge_few(data) if len(data) <= self.leaf_bytes else self._merge_many(data)

    def _merge_few(self, data: bytes) -> list[int]:
        rank, cuts = self.ranks.get, list(range(len(data) + 1))
        cost = [rank(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
        while cost:
            best = min(cost)
            if best == NO_RANK:
                break
            i = cost.index(best)
            del cuts[i + 1], cost[i]
            if i:
                cost[i - 1] = rank(data[cuts[i - 1]:cuts[i + 1]], NO_RANK)
            if i < len(cost):
                cost[i] = rank(data[cuts[i]:cuts[i + 2]], NO_RANK)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_many(self, data: bytes) -> list[int]:
        """The same with a heap, for windows that had to grow."""
        rank, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))  # part at i: data[i:end[i]]; 0 once merged into its left one
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i:i + 2], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)

        def offer(i):
            if i >= 0 and end[i] < n:
                stop = end[end[i]]
                if (r := rank(data[i:stop], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, i, stop))

        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:  # one of the two was merged since
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i:end[i]]])
            i = end[i]
        return out

    def holds(self, a: int, b: int) -> bool:
        """Is ``[a, b]`` the encoding of its own bytes?"""
        found = self.firm.get((a, b))
        if found is None:
            if len(self.firm) > REMEMBERED:
                self.firm.clear()
            found = self.firm[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return found

    def join_tokens(self, x: tuple, y: tuple) -> tuple:
        """Encoding of the bytes of ``x`` and then ``y``, both encodings."""
        if not x or not y:
            return x or y
        i = j = 1
        while True:
            i, j = min(i, len(x)), min(j, len(y))
            window = self.merge(b"".join(map(self.token.__getitem__, chain(x[len(x) - i:], y[:j]))))
            left = i == len(x) or self.holds(x[-i - 1], window[0])
            right = j == len(y) or self.holds(window[-1], y[j])
            if left and right:
                return (*x[:len(x) - i], *window, *y[j:])
            i, j = i if left else 2 * i, j if right else 2 * j

    def _tokens(self, data: bytes) -> tuple:
        if len(data) <= self.leaf_bytes:
            return tuple(self.merge(data))
        half = 1 << (len(data) - 1).bit_length() - 1  # a power of two, so runs of one character stay aligned
        return self.join_tokens(self._tokens(data[:half]), self._tokens(data[half:]))

    def tokens(self, piece: str) -> tuple:
        """Tokens of one piece; one that is a token as a whole is that token."""
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                data = piece.encode()
                whole = self.ranks.get(data)
                found = (whole,) if whole is not None else self._tokens(data)
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[piece] = found
        return found

    # -------------------------------------------------------------- one text
    def leaf(self, text: str) -> tuple[list, list]:
        """Pieces of a text and the tokens of each."""
        pieces = self.cut(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self.tokens(p) if t is None else t for p, t in zip(pieces, found)]
        return pieces, found

    def join(self, left: tuple, right: tuple) -> tuple[list, list]:
        """Pieces and tokens of the joined texts of two sides."""
        (lp, lt), (rp, rt) = left, right
        if not lp or not rp:
            return left if lp else right
        open_, after = 0, 0
        while open_ < len(lp) and after < LOOK_AHEAD:
            open_ += 1
            after += len(lp[-open_])
        tail = "".join(lp[len(lp) - open_:])
        j = 2
        while True:
            j = min(j, len(rp))
            starts = {len(tail) + at: k for k, at in enumerate(accumulate(map(len, rp[:j]), initial=0))}
            window = tail + "".join(rp[:j])
            pieces = self.cut(window)
            ends = list(accumulate(map(len, pieces)))
            if j == len(rp):
                n, k = len(pieces), j
                break
            settled = [(n, starts[e]) for n, e in enumerate(ends, 1)
                       if e in starts and e >= len(tail) and e + LOOK_AHEAD <= len(window)]
            if settled:
                n, k = settled[0]
                break
            j *= 2
        whole, joined = lp[-1] + rp[0], []
        for p in pieces[:n]:
            # a long piece that the cut divided: its halves are encoded already
            if p == whole and len(p) > REMEMBERED_CHARS and p.encode() not in self.ranks:
                joined.append(self.join_tokens(lt[-1], rt[0]))
            else:
                joined.append(self.tokens(p))
        keep = len(lp) - open_
        return lp[:keep] + pieces[:n] + rp[k:], lt[:keep] + joined + rt[k:]

    def parts(self, text: str) -> tuple[list, list]:
        """Pieces and their tokens, by halves."""
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.parts(text[:half]), self.parts(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.parts(text)[1]), "<u4")

    def decode(self, ids) -> bytes:
        if len(ids) <= self.leaf_chars:
            token = self.token.get
            return b"".join([token(i, b"") for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(text: str) -> dict[bytes, int]:
    """Lines of a base64 byte string and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(str.split, filter(None, text.splitlines()))}


@lru_cache(maxsize=2)
def _vocabulary(text: str, pattern: str, leaf_chars: int) -> Vocabulary:
    """One per Python worker: what it remembers serves all its tasks."""
    return Vocabulary(read_ranks(text), pattern, leaf_chars)


def packed_ids(ids: list[np.ndarray], decoded: list[bytes]) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
         pa.array(decoded, pa.binary())], ["n_tokens", "ids", "decoded"])


RESULT = "struct<n_tokens:bigint,ids:binary,decoded:binary>"


class Codec:
    """A rank file and pattern, ready on every node."""

    def __init__(self, spark, ranks_path: str, pattern: str, segment: int = SEGMENT, leaf_chars: int = LEAF_CHARS):
        common.prepare(spark)
        with open(ranks_path, encoding="utf-8") as f:
            self.spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the corpus
        self.pattern, self.segment, self.leaf_chars = pattern, segment, leaf_chars

    def _vocabulary(self):
        spec, pattern, leaf_chars = self.spec, self.pattern, self.leaf_chars
        return lambda: _vocabulary(spec.value, pattern, leaf_chars)

    def encode(self, docs: DataFrame, text_col: str = "text", out: str = "_ids") -> DataFrame:
        """``docs`` plus ``out array<bigint>``, the ids of each text."""
        @F.arrow_udf("array<bigint>")
        def unpacked(column: pa.Array) -> pa.Array:
            return common.list_array([np.frombuffer(x.as_py() or b"", "<u4") for x in column], pa.int64())

        packed = self._applied(docs, text_col, out, decode=False)
        return packed.withColumn(out, unpacked(F.col(f"`{out}`")["ids"]))

    def decode(self, docs: DataFrame, ids_col: str = "_ids", out: str = "_decoded") -> DataFrame:
        """``docs`` plus ``out binary``, the bytes of the ids; ids the vocabulary lacks give none."""
        vocabulary = self._vocabulary()

        @F.arrow_udf("binary")
        def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            v = vocabulary()
            for rows in column:
                yield pa.array([v.decode(ids or []) for ids in rows.to_pylist()], pa.binary())

        return docs.withColumn(out, run(F.col(f"`{ids_col}`").cast("array<bigint>")))

    def round_trip(self, docs: DataFrame, text_col: str = "text", out: str = "_bpe") -> DataFrame:
        """``docs`` plus ``out struct<n_tokens, ids, decoded>``: the ids as
        little-endian unsigned 32-bit integers, and the bytes they decode to."""
        return self._applied(docs, text_col, out, decode=True)

    def _applied(self, docs: DataFrame, text_col: str, out: str, decode: bool) -> DataFrame:
        vocabulary, columns = self._vocabulary(), [c for c in docs.columns if c != out]

        @F.arrow_udf(RESULT)
        def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            v = vocabulary()
            for texts in column:
                ids = [v.encode(t.as_py() or "") for t in texts]
                yield packed_ids(ids, [v.decode(x.tolist()) if decode else None for x in ids])

        text = F.col(f"`{text_col}`")
        long = F.coalesce(F.length(text) > self.segment, F.lit(False))
        short = docs.where(~long).select(*[F.col(f"`{c}`") for c in columns], run(text).alias(out))
        keyed = common.packed(docs.where(long), text=text, key=F.sha2(text, 256))
        found = self._long(keyed.select("key", "text").dropDuplicates(["key"]), decode)
        joined = keyed.drop("text").join(found, "key")
        return short.unionByName(common.unpacked(joined, columns, **{out: F.col("found")}))

    def _long(self, texts: DataFrame, decode: bool) -> DataFrame:
        """``(key, found)`` of texts of more than a segment: segments are encoded
        in tasks of their own, and each text's are joined up the tree."""
        vocabulary, size = self._vocabulary(), self.segment

        def cut(batches):
            for b in batches:
                for key, text in zip(b.column("key").to_pylist(), b.column("text")):
                    text = text.as_py()
                    for i in range(0, len(text), size):
                        yield pa.RecordBatch.from_pydict(
                            {"key": [key], "seg": pa.array([i // size], pa.int64()), "text": [text[i:i + size]]})

        def encode(batches):
            v = vocabulary()
            for b in batches:
                for key, seg, text in zip(*(b.column(n).to_pylist() for n in ("key", "seg", "text"))):
                    tokens = v.parts(text)[1]
                    counts = np.fromiter(map(len, tokens), "<u4")
                    ids = np.fromiter(chain.from_iterable(tokens), "<u4")
                    yield pa.RecordBatch.from_pydict({"key": [key], "seg": pa.array([seg], pa.int64()), "text": [text],
                                                      "counts": [counts.tobytes()], "ids": [ids.tobytes()]})

        def join(table: pa.Table) -> pa.Table:
            v = vocabulary()
            rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
            sides = []
            for r in rows:
                ids = np.frombuffer(r["ids"], "<u4").tolist()
                ends = np.cumsum(np.frombuffer(r["counts"], "<u4"), dtype=np.int64).tolist()
                sides.append((v.cut(r["text"]), [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]))
            while len(sides) > 1:
                sides = [v.join(*sides[i:i + 2]) if i + 1 < len(sides) else sides[i] for i in range(0, len(sides), 2)]
            ids = np.fromiter(chain.from_iterable(sides[0][1]), "<u4")
            return pa.table({"key": [rows[0]["key"]], "found": packed_ids([ids], [v.decode(ids.tolist()) if decode else None])})

        segments = texts.mapInArrow(cut, "key string, seg bigint, text string").repartition("key", "seg")
        encoded = segments.mapInArrow(encode, "key string, seg bigint, text string, counts binary, ids binary")
        return encoded.groupBy("key").applyInArrow(join, f"key string, found {RESULT}")
