r"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The tokenizer file (a public vocabulary with merges and an end-of-word suffix)
is a parameter.  Encoding:

1. all words of the corpus are counted by one distributed sum; the
   most frequent (``lexicon_size`` at most) are encoded once on the driver;
2. these words are compiled into a minimal acyclic automaton: words share prefixes
   and suffixes, and every arc carries a number such that the numbers along a
   word add up to its rank, which addresses its ids.  The automaton is one
   file of plain arrays that Spark ships to every node (``addFile``) and every
   Python worker memory-maps, so the workers of a node share its pages;
3. each task cuts a block of texts into words by array operations over its code
   points, looks the distinct new words up in the automaton (all words at once,
   one byte position at a time), and merges words that are not in it by the
   exact merge rules.  The lexicon decides speed, never results.

Text is treated as the tokenizer file says: special tokens are cut out of the
raw text, the rest is normalised to NFC and lower case, white space is dropped,
and words are letters, single digits, runs of other marks, or English
contractions.  Decoding joins the tokens' strings with a blank, as the file
names no decoder.

Defined cases: a null or empty text has no tokens; ids decode to the empty
text when null or empty; texts of any length are encoded whole; repeated rows
are encoded alike; extra columns are kept; an empty table gives no rows.
Letter classes and lower case are those of the installed Python and ``regex``;
they differ from the tokenizers library only for code points that Unicode
assigned lately.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize

LEXICON_SIZE = 100_000
#: Words remembered by a worker before it starts afresh.
REMEMBERED = 200_000
LONG_WORD = 64
#: Texts are cut into words in pieces of about this many code points, at white space.
PIECE = 1 << 20
#: Fixed by the tokenizer file: contractions that are words, by their letters.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SUFFIX = "</w>"
SPACE, LETTER, DIGIT, OTHER = range(4)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Vocabulary and merges of a tokenizer file, with exact encoding of words."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + SUFFIX] for s in symbols]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                 if self.special else r"(?!)()")

    def parts(self, text: str) -> list:
        """Normalised runs of a text, and the ids of its special tokens between them."""
        if not any(s in text for s in self.special):
            return [normalise(text)]
        return [self.special[part] if k % 2 else normalise(part) for k, part in enumerate(self.cut.split(text))]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The merge rules on one word: the pair of lowest rank first, leftmost first."""
        data = word.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        if len(ids) > LONG_WORD:
            return self._encode_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at: at + 2] = [best[1]]
        return tuple(ids)

    def _encode_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list, for words of any length."""
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i):
            j = nxt[i]
            if j < n and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one side has been merged since
            ids[i], ids[j] = to, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                push(prev[i])
            push(i)
        return tuple(x for x in ids if x is not None)


def normalise(text: str) -> str:
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # lower case is per character: no final sigma


def class_table() -> np.ndarray:
    """White space, letter, digit or other, of every code point."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[ord(every[m.start()]): ord(every[m.end() - 1]) + 1] = kind
    return table


def cut_words(text: str, begins: np.ndarray, classes: np.ndarray):
    """64-bit hash, start and end of every word of ``text``, several runs one after
    the other that begin at ``begins``: letters, one digit, other marks, or an
    English contraction where its apostrophe begins a word."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    kind = classes[cp]
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    edge = edge[:n]
    start = edge | (kind == DIGIT)
    start[1:] |= kind[1:] != kind[:-1]
    start &= kind != SPACE
    mark = np.flatnonzero(start & (cp == 39))
    if len(mark):
        run = np.append(np.cumsum(edge), -1)  # the run of each code point
        far = np.append(cp, [0, 0, 0])
        for letters in CONTRACTIONS:
            k = len(letters)
            hit = mark[(mark + k < n)]
            for j, c in enumerate(letters, 1):
                hit = hit[far[hit + j] == ord(c)]
            hit = hit[run[hit + k] == run[hit]]
            start[hit + 1] = False
            after = hit + k + 1
            after = after[after < n]
            start[after[kind[after] == LETTER]] = True
    stop = np.flatnonzero(start | (kind == SPACE))
    at = np.flatnonzero(start[stop])
    starts, ends = stop[at], np.append(stop, n)[at + 1]
    up, down = common._powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return common.mix(h), starts, ends


def pieces(runs: Iterator[tuple[int, str]]):
    """Groups of (owner, run) of bounded size; a long run is cut at white space."""
    held, size = [], 0
    for owner, run in runs:
        at = 0
        while at < len(run):
            stop = len(run)
            if stop - at > 2 * PIECE and (m := _BLANK.search(run, at + PIECE)):
                stop = m.end()
            held.append((owner, run[at:stop]))
            size, at = size + stop - at, stop
            if size > PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


_BLANK = regex.compile(r"\s")


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of ``entries``.

    Sorted words are added one after the other; the part of the previous word
    that the next one does not share is frozen from its end, and a frozen state
    equal to an earlier one is replaced by it.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path = [[False, []]]  # of the previous word: [final, frozen arcs]
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            path[-2][1].append((labels.pop(), freeze(path.pop())))
    words = sorted(entries)
    previous = b""
    for w in words:
        shared = len(os.path.commonprefix([previous, w]))
        close(shared)
        for c in w[shared:]:
            labels.append(c)
            path.append([False, []])
        path[-1][0] = True
        previous = w
    close(0)
    root = freeze(path[0])
    below = np.zeros(len(states), np.int64)  # words from each state on; children come first
    keys, targets, numbers = [], [], []
    for s, (final, arcs) in enumerate(states):
        at = int(final)
        for c, to in arcs:
            keys.append(s * 256 + c)
            targets.append(to)
            numbers.append(at)
            at += int(below[to])
        below[s] = at
    off = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(entries[w]) for w in words], out=off[1:])
    return {"root": np.array([root], np.int64), "keys": np.array(keys, np.int64),
            "targets": np.array(targets, np.int64), "numbers": np.array(numbers, np.int64),
            "final": np.array([f for f, _ in states], np.int64), "offsets": off,
            "ids": np.fromiter(chain.from_iterable(entries[w] for w in words), np.int64)}


FIELDS = ("root", "keys", "targets", "numbers", "final", "offsets", "ids")


def write_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the lengths of the arrays, then the arrays."""
    with open(path, "wb") as f:
        f.write(np.array([len(arrays[k]) for k in FIELDS], np.int64).tobytes())
        for k in FIELDS:
            f.write(np.ascontiguousarray(arrays[k], np.int64).tobytes())


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.int64, "r")
        at = len(FIELDS)
        for k, n in zip(FIELDS, raw[: len(FIELDS)].tolist()):
            setattr(self, k, raw[at: at + n])
            at += n

    def look_up(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The ids of each word, or None."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        if not len(self.keys):
            return out
        n = np.array([len(w) for w in words])
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.root[0])
        rank = np.zeros(len(words), np.int64)
        live, step = np.arange(len(words)), 0
        while len(live := live[n[live] > step]):
            key = state[live] * 256 + data[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            rank[live] += self.numbers[at]
            step += 1
        found = np.flatnonzero((state >= 0) & (self.final[np.maximum(state, 0)] == 1) & (n > 0))
        lo, hi = self.offsets[rank[found]].tolist(), self.offsets[rank[found] + 1].tolist()
        for i, a, b in zip(found.tolist(), lo, hi):
            out[i] = tuple(self.ids[a:b].tolist())
        return out


def count_words(docs: DataFrame, text_col: str, spec) -> DataFrame:
    """``word, n`` over all texts; ``spec`` is the broadcast tokenizer file."""

    def run(batches):
        (tok, classes), counts, words = tokenizer_of(spec), {}, {}

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([words[h] for h in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            words.clear()
            return batch

        for batch in batches:
            runs = ((0, part) for t in batch.column(0) for part in tok.parts(t.as_py() or "") if isinstance(part, str))
            for piece in pieces(runs):
                text = "".join(r for _, r in piece)
                begins = np.cumsum([0, *(len(r) for _, r in piece)])
                h, starts, ends = cut_words(text, begins, classes)
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                for k, c, a, b in zip(h.tolist(), n.tolist(), starts[at].tolist(), ends[at].tolist()):
                    if k in counts:
                        counts[k] += c
                    else:
                        counts[k], words[k] = c, text[a:b]
                if len(counts) > REMEMBERED:
                    yield flush()
        yield flush()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_KEPT: dict = {}


def tokenizer_of(spec) -> tuple[Tokenizer, np.ndarray]:
    """The worker's tokenizer of a broadcast file, and the classes of code points."""
    if _KEPT.get("spec") != spec.value:
        _KEPT.clear()
        _KEPT.update(spec=spec.value, tokenizer=Tokenizer(spec.value), classes=class_table())
    return _KEPT["tokenizer"], _KEPT["classes"]


def words_of(spec, lexicon_file: str):
    """The worker's tokenizer, words met so far, classes and token strings."""
    tok, classes = tokenizer_of(spec)
    if _KEPT.get("lexicon") != lexicon_file:
        tokens = np.empty(max(tok.tokens) + 1, object)
        for i, t in tok.tokens.items():
            tokens[i] = t
        _KEPT.update(lexicon=lexicon_file, words=Words(Lexicon(SparkFiles.get(lexicon_file)), tok), tokens=tokens)
    return tok, _KEPT["words"], classes, _KEPT["tokens"]


class Words:
    """The ids of the words a worker has met, by hash."""

    def __init__(self, lexicon: Lexicon, tok: Tokenizer):
        self.lexicon, self.tok = lexicon, tok
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.off, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def positions(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        """Place of each distinct word among ``off``; new words are added."""
        if len(self.index) > REMEMBERED:
            self.clear()
        get = self.index.get
        at = np.array([get(k, -1) for k in h.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            found = self.lexicon.look_up([w.encode() for w in words])
            found = [self.tok.encode_word(w) if ids is None else ids for w, ids in zip(words, found)]
            at[new] = np.arange(len(new)) + len(self.off) - 1
            self.index.update(zip(h[new].tolist(), at[new].tolist()))
            more = np.cumsum([len(x) for x in found]) + self.off[-1]
            self.off = np.concatenate([self.off, more])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])
        return at


def encode_texts(texts: pa.Array, tok: Tokenizer, words: Words, classes: np.ndarray) -> pa.ListArray:
    """Ids of each text."""
    flat, special = [], {}  # ids in row order; texts with special tokens, by row
    n_ids = np.zeros(len(texts), np.int64)

    def runs():
        for i, t in enumerate(texts):
            parts = tok.parts(t.as_py() or "")
            if len(parts) == 1:
                yield i, parts[0]
            else:
                special[i] = parts

    def encoded(piece):
        """Ids of a piece, and how many belong to each of its runs."""
        text = "".join(r for _, r in piece)
        begins = np.cumsum([0, *(len(r) for _, r in piece)])
        h, starts, ends = cut_words(text, begins, classes)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = words.positions(u, starts[first], ends[first], text)[back]
        lo, n = words.off[at], words.off[at + 1] - words.off[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = words.ids[np.arange(total[-1]) + np.repeat(lo - total[:-1], n)]
        return ids, np.diff(total[np.searchsorted(starts, begins)])

    for piece in pieces(runs()):
        ids, n = encoded(piece)
        flat.append(ids)
        np.add.at(n_ids, [i for i, _ in piece], n)
    off = np.concatenate([[0], np.cumsum(n_ids)])
    flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    if special:
        rows = [flat[a:b] for a, b in zip(off, off[1:])]
        for i, parts in special.items():
            rows[i] = np.concatenate([np.zeros(0, np.int32), *(
                np.array([part], np.int32) if isinstance(part, int) else encoded(piece)[0]
                for part in parts for piece in ([None] if isinstance(part, int) else pieces([(i, part)])))])
        return common.list_array(rows, pa.int32())
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, pa.int32()))


def decode_ids(ids: pa.ListArray, tokens: np.ndarray) -> pa.Array:
    """The tokens' strings, joined by a blank."""
    off, flat = np.asarray(ids.offsets), np.asarray(ids.values)
    return pa.array([" ".join(tokens[flat[a:b]].tolist()) for a, b in zip(off, off[1:])], pa.string())


class Codec:
    """A tokenizer file and the lexicon of a corpus, ready on every node."""

    def __init__(self, spark, tokenizer_path: str, lexicon_file: str, spec):
        self.spark, self.tokenizer_path, self.lexicon_file, self.spec = spark, tokenizer_path, lexicon_file, spec

    def encode(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` plus ``_ids array<int>``."""
        spec, name = self.spec, self.lexicon_file

        @F.arrow_udf("array<int>")
        def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tok, words, classes, _ = words_of(spec, name)
            for texts in column:
                yield encode_texts(texts, tok, words, classes)

        return docs.withColumn("_ids", run(F.col(text_col)))

    def decode(self, docs: DataFrame, ids_col: str = "_ids") -> DataFrame:
        """``docs`` plus ``_decoded string``."""
        spec, name = self.spec, self.lexicon_file

        @F.arrow_udf("string")
        def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = words_of(spec, name)[3]
            for ids in column:
                yield decode_ids(ids, tokens)

        return docs.withColumn("_decoded", run(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))

    def round_trip(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` plus ``_bpe struct<ids, decoded>`` in one pass: one Python worker a task."""
        spec, name = self.spec, self.lexicon_file

        @F.arrow_udf("struct<ids:array<int>,decoded:string>")
        def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tok, words, classes, tokens = words_of(spec, name)
            for texts in column:
                ids = encode_texts(texts, tok, words, classes)
                yield pa.StructArray.from_arrays([ids, decode_ids(ids, tokens)], ["ids", "decoded"])

        return docs.withColumn("_bpe", run(F.col(text_col)))


def build_codec(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                lexicon_size: int = LEXICON_SIZE) -> Codec:
    """Count the corpus's words and ship the lexicon of the most frequent ones."""
    spark = docs.sparkSession
    common.prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = spark.sparkContext.broadcast(text)  # a vocabulary file, whatever the corpus
    counts = materialize(count_words(docs, text_col, spec), "words")
    top = common.most_frequent(counts, lexicon_size).select("word").toPandas()["word"]
    tok = Tokenizer(text)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="covgrid-lexicon-"), name)  # only the source of addFile
    write_lexicon(compile_lexicon({w.encode(): tok.encode_word(w) for w in top}), path)
    spark.sparkContext.addFile(path)
    return Codec(spark, tokenizer_path, name, spec)
