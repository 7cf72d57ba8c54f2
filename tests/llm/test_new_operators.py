"""Byte-level BPE, spelling variants and the Merkle manifest against the library or brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from covgrid.llm import byte_bpe, merkle_manifest, queries, spelling_variants

tokenizers_files = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

RANKS = tokenizers_files.path("byte_bpe_50k.tiktoken")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = [None, "", " \n\t ", "one", "don't we'll 'r 're", "  two  spaces \n\n x", "a" * 700, " " * 333 + "x", "ab" * 400,
         "Ünïcode wörds 日本語 \U0001F600 ́x", "<|endoftext|> \\ \x00\x1f\x85 ", "Wort " * 900, "=" * 130 + "12345" * 40]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, encoding="utf-8") as f:
        ranks = byte_bpe.read_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    """A null id, repeated rows, and extra columns that clash with inner names."""
    rows = [(i, t, "k", "d", 1) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "k", "d", 1), (None, "null id", None, "d", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, doc string, seg int").repartition(3)


# ------------------------------------------------------------------- byte-level BPE
@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(1, 1), (2, 32), (3, 2), (7, 4), (64, 8)])
def test_tree_equals_library(library, leaf_chars, leaf_bytes):
    ranks, enc = library
    v = byte_bpe.Vocabulary(ranks, tokenizers_files.PATTERN, leaf_chars, leaf_bytes)
    rng = random.Random(leaf_chars)
    bits = [" ", "  ", "\n", "\t", "a", "the", "'", "s", "re", "ll", "1", "23", "é", "日本", "!", "aaaa", " hello", "\U0001F600", "ing"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for t in texts:
        ids = v.encode(t).tolist()
        assert ids == enc.encode_ordinary(t), t
        assert v.decode(ids) == t.encode()


def test_join_is_associative(library):
    ranks, _ = library
    v = byte_bpe.Vocabulary(ranks, tokenizers_files.PATTERN)
    a, b, c = (v.leaf(t) for t in ("it  ", " '", "re\n here"))
    assert v.join(v.join(a, b), c) == v.join(a, v.join(b, c)) == v.leaf("it   're\n here")
    assert v.join(v.leaf(""), a) == a == v.join(a, v.leaf(""))


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_codec(spark, docs, library, segment):
    _, enc = library
    codec = byte_bpe.Codec(spark, RANKS, tokenizers_files.PATTERN, segment=segment, leaf_chars=16)
    out = codec.round_trip(docs)
    assert out.columns == [*docs.columns, "_bpe"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = enc.encode_ordinary(r.text or "")
        assert np.frombuffer(r._bpe.ids, "<u4").tolist() == ids and r._bpe.n_tokens == len(ids)
        assert bytes(r._bpe.decoded) == (r.text or "").encode()
    assert Counter((r.doc_id, r.text, r.key, r.doc, r.seg) for r in rows) == Counter(map(tuple, docs.collect()))
    assert codec.round_trip(docs.limit(0)).count() == 0


def test_codec_encode_decode(spark, docs, library):
    _, enc = library
    codec = byte_bpe.Codec(spark, RANKS, tokenizers_files.PATTERN)
    back = codec.decode(codec.encode(docs)).collect()
    assert all(r._ids == enc.encode_ordinary(r.text or "") and bytes(r._decoded) == (r.text or "").encode() for r in back)
    odd = spark.createDataFrame([(None,), ([],), ([50256, None, 464],)], "_ids array<long>")
    assert [bytes(r._decoded) for r in codec.decode(odd).collect()] == [b"", b"", b"The"]


def test_op11_query(spark, library, tmp_path):
    _, enc = library
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in queries.op11_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256((t or "").encode()).hexdigest())


# ---------------------------------------------------------------- spelling variants
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def scanned(words):
    raw = [w.encode("latin-1") for w in words]
    off = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    zero = np.zeros(len(raw), np.int64)
    a, b = spelling_variants.one_edit(np.frombuffer(b"".join(raw), np.uint8), off, zero, zero, np.arange(len(raw)))
    return sorted(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("states", [3, 1 << 18])
def test_scan_equals_brute_force(states, monkeypatch):
    monkeypatch.setattr(spelling_variants, "STATES", states)
    rng = random.Random(5)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))})
        assert scanned(words) == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if x != y and one_edit(x, y)]


def test_scan_skips_ranges():
    """Ranges further than one edit are not entered: states stay far below all pairs."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(3000)})
    seen, repeat = [], np.repeat
    np.repeat = lambda x, n, *a, **k: (seen.append(1), repeat(x, n, *a, **k))[1]
    try:
        scanned(words)
    finally:
        np.repeat = repeat
    assert len(seen) < 200  # steps down the list, not one per pair


@pytest.mark.parametrize("block", [8, 4096])
def test_near_pairs(spark, block, monkeypatch):
    """Blocks of eight words: every part is dealt in pairs of blocks."""
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    rng = random.Random(block)
    words = sorted({"".join(rng.choice("abÀ") for _ in range(rng.randint(1, 8))) for _ in range(300)} | {"x" * 5000, "x" * 5001})
    got = spelling_variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    pairs = [tuple(sorted(r)) for r in got]
    assert sorted(pairs) == [(x, y) for i, x in enumerate(words) for y in words[i + 1:] if one_edit(x, y)]


def brute_variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def test_op12_query(spark, tmp_path):
    rng = random.Random(8)
    base = ["Abfahrten", "straßen", "ÉCOLESétés", "ankunftszeit", "abcdefg"]
    typo = ["abfahrtem", "abfahrtenn", "strassen", "ankunftzeit", "abcdefgh", "abcdfg"]
    rows = [(rng.choice([None, *range(9)]), " ".join(rng.choices(base, k=400)) + " " + " ".join(rng.choices(typo, k=9)))
            for _ in range(12)]
    rows += [(1, None), (2, ""), (3, "1 2 kurz"), (4, "w" * 3000 + " " + "w" * 3000), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_spelling_variants(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    expected = brute_variants(rows)
    assert got == expected
    assert any(r[1] for r in got) and any(len(r[0]) == 3000 for r in got)


def test_roots_follow_chains(spark):
    vocab = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("zzzzzzz", 5)],
                                  "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling_variants.variants(vocab).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb") and got["zzzzzzz"] == (None, "zzzzzzz")


def test_variants_of_nothing(spark):
    assert spelling_variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ Merkle manifest
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """The root, and for each node its siblings and the runs it climbs."""
    proof, runs, below = [[] for _ in nodes], [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i:i + 3]
            for j in range(len(run)):
                for k in below[i + j]:
                    proof[k] += run[:j] + run[j + 1:]
                    runs[k].append((run, j))
            up.append(H(*run))
            under.append(sum(below[i:i + 3], []))
        nodes, below = up, under
    return nodes[0], proof, runs


def brute_manifest(rows):
    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return H(value(r["doc_id"]), value(r["source"]), value(r["lang"]), value(r["n_chars"]), value(text))
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names, trees = sorted(by, key=lambda s: (s is not None, (s or "").encode())), {}
    for s in names:
        mine = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = (mine, *brute_tree([leaf(r, r["text"]) for r in mine]))
    root, above, upper = brute_tree([trees[s][1] for s in names])
    out = []
    for k, s in enumerate(names):
        mine, sub, proof, runs = trees[s]
        for i, r in enumerate(mine):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for run, j in runs[i] + upper[k]:
                node = H(*run[:j], node, *run[j + 1:])
            out.append((r["doc_id"], leaf(r, r["text"]), sub, root, H(*proof[i], *above[k]), node, node == root))
    return sorted(out, key=repr)


def some_rows(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i, i]), rng.choice(["a\nb", "\n", None, "", "x"]), "en",
             rng.choice([None, "s1", "s1", "s1", "s2", "é", ""]), i, "extra") for i in range(n)]
    return rows + rows[:2]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string"


@pytest.mark.parametrize("levels,n", [(1, 40), (2, 100), (6, 1)])
def test_manifest_in_blocks(spark, levels, n):
    """Blocks of three and nine leaves: several rounds of block roots."""
    df = spark.createDataFrame(some_rows(n, n), SCHEMA).repartition(3)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle_manifest.manifest(df, suspect={"text": text}, levels=levels)
    got = [(None if r.id is None else int(r.id), r.leaf, r.subroot, r.root, H(*r.proof), r.folded_root, r.verified)
           for r in out.collect()]
    expected = brute_manifest([r.asDict() for r in df.collect()])
    assert sorted(got, key=repr) == expected


def test_frontier_equals_brute_force():
    for n in range(1, 40):
        f, nodes = merkle_manifest.Frontier(), [H(str(i)) for i in range(n)]
        for x in nodes:
            f.append(x)
        root, proof, _ = brute_tree(nodes)
        assert f.close(None) == root and f.witness == proof
        for i, x in enumerate(nodes):
            assert merkle_manifest.fold(x, proof[i], [(i, n)]) == root
            assert n == 1 or merkle_manifest.fold(H("other"), proof[i], [(i, n)]) != root


def test_manifest_unchanged_and_empty(spark):
    df = spark.createDataFrame(some_rows(20, 3), SCHEMA)
    assert {r.verified for r in merkle_manifest.manifest(df).select("verified").collect()} == {True}
    assert merkle_manifest.manifest(df.limit(0)).count() == 0


def test_op13_query(spark, tmp_path):
    df = spark.createDataFrame(some_rows(30, 7), SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_manifest([r.asDict() for r in df.collect()])


# ------------------------------------------------------------------ chosen rows
@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_chosen_equals_semi_join(spark, bits):
    """A bitmap of one word lets nearly all through; the result is the same."""
    from covgrid.llm import common

    common.prepare(spark)
    df = spark.createDataFrame([(i if i % 7 else None, f"t{i}") for i in range(400)] + [(5, "t5")], "id long, text string")
    ids = spark.createDataFrame([(i * 13,) for i in range(40)] + [(-4,), (5,), (399,)], "id long")
    got = sorted(map(tuple, common.chosen(df, ids, bits).collect()))
    assert got == sorted(map(tuple, df.join(ids, "id", "left_semi").collect())) and ("t5",) * 2 == tuple(
        t for i, t in got if i == 5)
    assert common.chosen(df, ids.limit(0), bits).count() == 0


def test_band_keys_are_dealt_packed(spark):
    """One row per range of keys goes through the shuffle, not one per key and content;
    the pairs are those of all contents that share a key, whatever the batches."""
    from covgrid.llm import substring_dedup as sd

    words = [[f"p{d}x{i}" for i in range(400)] for d in range(6)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(words)], "doc_id long, text string")
    rows = sd.Paragraphs(docs, "doc_id", "text", 5, 0.8, 0.99, 5, 64).keys().collect()
    pairs = np.concatenate([np.frombuffer(r["pairs"], np.int64).reshape(-1, 2) for r in rows])
    assert len(pairs)
    assert all(((np.frombuffer(r["pairs"], np.uint64)[::2] >> np.uint64(52)) == r["part"]).all() for r in rows)

    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 60, 300, dtype=np.int64)[rng.integers(0, 300, (500, 3))]
    contents = rng.permutation(500).astype(np.int64) - 250
    of = {}
    for c, own in zip(contents.tolist(), keys.tolist()):
        for x in own:
            of.setdefault(x, set()).add(c)
    want = set()
    for x, held in of.items():
        held = sorted(held)
        want |= {(x, held[0], c, True) for c in held[1:]} | {(x, a, b, False) for a, b in zip(held[1:], held[2:])}
    table = spark.createDataFrame([(k, c) for k, c in zip(keys.tolist(), contents.tolist())] * 2, "keys array<long>, content long")
    for parts in (1, 7):
        got = (table.repartition(parts).mapInArrow(sd.packed_rows, sd.PACKED_ROWS).repartition("part")
               .sortWithinPartitions("part").mapInArrow(sd._neighbours, "key long, a long, b long, star boolean").collect())
        assert sorted(map(tuple, got)) == sorted(want)


def test_near_duplicates_keep_one_worker_a_task(spark, monkeypatch):
    """No table is written by a plan with a Python filter before another Python step:
    both would be workers of one task, and idle ones keep their memory."""
    from covgrid.llm import minhash_dedup

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:n]) for n in (60, 58, 57, 30, 29)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, written = [], minhash_dedup.materialize

    def kept(df, name="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(minhash_dedup, "materialize", kept)
    found = {r["id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, k=3, percent=85).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    assert any("MapInArrow" in p for p in plans) and not any("ArrowEvalPython" in p for p in plans)
