"""Every training-data operator on a small table of awkward rows, against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from covgrid.llm import (bpe_codec, chat_format, common, decontaminate, embedding_dedup, language_id, line_dedup,
                         lm_scoring, minhash_dedup, substring_dedup, url_filter)

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
RNG = np.random.default_rng(3)
SYLLABLES = "an er on th re he in ed nd ha at en es of or".split()


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(70)
TEXTS = [
    None, "", " \n\t ", "one", "One two", BASE, BASE, BASE + " tail", BASE.replace("an", "An"),
    prose(30) + " " + PASSAGE + " " + prose(30), prose(10) + " " + PASSAGE + " " + prose(50), prose(4000),
    "the same line here\n\nThe same line HERE \nshort\nshort", "other\n the same line here", "the " * 300, "12 34 -- !!",
    "\\ <|end|> <", "Ünïcode wörds ärgern Übermut 日本語 \U0001F600",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with a repeated row and a null id; extra columns that clash with inner names."""
    rows = [(i, t, "x", "y", i) for i, t in enumerate(TEXTS)] + [(5, BASE, "x", "y", 5), (None, BASE, "x", "y", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, _text string, key long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def clusters(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(1, 50), (50, 30), (7, 8), (9, 9)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = clusters({x for e in edges for x in e}, edges)
    assert got == want


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_minhash(docs, empty, k, percent):
    got = {r["id"]: r for r in minhash_dedup.near_duplicates(docs, k=k, percent=percent, block=4).collect()}
    sets = {i: shingles(t, k) for i, t in enumerate(TEXTS)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = clusters(sets, links)
    assert {i: r["component_id"] for i, r in got.items() if i is not None} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items() if i is not None)
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert minhash_dedup.near_duplicates(empty, k=k, percent=percent).count() == 0


def test_posterior_bound_keeps_true_pairs():
    for n, least in minhash_dedup.least_matches(0.85, 256, 32, 1e-5):
        assert 0 <= least < 0.85 * n


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs.where("doc_id is not null"), batches=3)
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.columns[:5] == docs.columns

    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOW)
    owner = {}
    for i, t in enumerate(TEXTS):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), i)
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        keep = [x for x in lines if owner.get(key(x), i) == i]
        r = got[i, t]["_lines"]
        assert (r["n_lines"], r["n_dropped"], r["kept"]) == (len(lines), len(lines) - len(keep), "\n".join(keep))
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs.where("doc_id is null")).first()["_lines"]["n_dropped"] == 0


def test_line_dedup_order_of_batches(spark):
    rows = [(i, f"shared line number {i % 7}\nown line number {i}") for i in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=5, fanout=2).collect()
    assert {r["doc_id"]: r["_lines"]["n_dropped"] for r in out} == {i: int(i >= 7) for i in range(60)}


def test_line_dedup_shuffles_a_text_once(docs):
    """The packed row holds no second copy of the text; a null text and the order of columns stay."""
    out = line_dedup.dedup_lines(docs.select("text", "doc_id"))
    assert "text, text#" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["text", "doc_id", "_lines"]
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_decontaminate(spark, docs, empty):
    w = BASE.split()
    items = [("a", " ".join(w[5:30])), ("b", "One, TWO"), ("c", None), ("d", ""), (None, PASSAGE), ("a", " ".join(w[5:30])),
             ("e", prose(40))]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    for block in (1 << 20, 20):
        got = {(r["id"], r["n_words"]): r for r in decontaminate.decontaminate(docs, bench, block=block).collect()}
        for i, t in enumerate(TEXTS):
            doc, hit, met = cut(t), set(), set()
            for item, text in items:
                it = cut(text)
                m = min(10, len(it))
                for p in range(len(it) - m + 1 if m else 0):
                    for q in range(len(doc) - m + 1):
                        if doc[q:q + m] == it[p:p + m]:
                            hit.update(range(q, q + m))
                            met |= {item} - {None}
            r = got[i, len(doc)]
            assert (r["n_hit"], r["item_ids"], r["contaminated"]) == (len(hit), sorted(met), bool(hit))
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_substring(spark, docs, empty):
    out = substring_dedup.repeated_passages(docs)
    by_doc = collections.defaultdict(list)
    for r in out.collect():
        by_doc[r["doc_id"]].append(r)
    assert {9, 10} <= set(by_doc) and not by_doc.keys() & {0, 1, 2, 3, 4, 11, 12, 13, 15, 16, 17}
    assert by_doc[10][0]["removed"] and not by_doc[9][0]["removed"] and by_doc[10][0]["first_doc"] == 9
    cut = {r["doc_id"]: r for r in substring_dedup.without_passages(docs.where("doc_id in (9, 10)"), out).collect()}
    assert cut[9]["text"] == TEXTS[9] and len(cut[10]["text"].split()) < len(TEXTS[10].split()) - 30
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_paragraphs_do_not_depend_on_neighbours():
    a, b = RNG.integers(0, 1 << 62, 200, dtype=np.uint64), RNG.integers(0, 1 << 62, 90, dtype=np.uint64)
    alone = substring_dedup.paragraph_ends(b, np.zeros(90, int), 1, 5, 64)
    both = substring_dedup.paragraph_ends(np.concatenate([a, b]), np.repeat([0, 1], [200, 90]), 2, 5, 64)
    assert (both[both > 200] - 200).tolist() == alone.tolist()


class OneBucket:
    """Contents that all share a band key: unrelated ones, and near pairs amid them."""

    def __init__(self, spark):
        rng = np.random.default_rng(8)
        self.shingles = [rng.integers(0, 1 << 40, 10).tolist() for _ in range(60)]
        for _ in range(30):
            s = rng.integers(0, 1 << 40, 10).tolist()
            self.shingles += [s + [1, 2], s + [3, 1, 1]]
        self.names = rng.permutation(len(self.shingles)).tolist()
        rows = [([7], c, s) for c, s in zip(self.names, self.shingles)]
        self.rows = spark.createDataFrame(rows, "keys array<long>, content long, shingles array<long>").repartition(3)

    def keys(self):
        return self.rows.select("keys", "content").union(self.rows.select("keys", "content"))

    def sets(self):
        return self.rows.select("content", "shingles")


@pytest.mark.parametrize("block", [2048, 16])
def test_substring_compares_every_colliding_pair(spark, block):
    p = OneBucket(spark)
    sets = {c: set(s) for c, s in zip(p.names, p.shingles)}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i: c for i, c in clusters(sets, near).items() if any(i in x for x in near)}
    got = {r["id"]: r["component"] for r in substring_dedup.near_contents(p, 0.8, block).collect()}
    assert len(near) == 30 and got == want


def test_substring_bands_are_selective():
    bands, rows = substring_dedup.tune_bands(0.8, 0.99)
    assert rows >= 2 and 1 - (1 - 0.8 ** rows) ** bands >= 0.99


def test_longest_shared_words_are_those_of_any_document():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    rows = collections.defaultdict(set)
    for g in range(4):
        for _ in range(80):
            rows[g, rng.integers(0, 3, rng.integers(1, 7)).astype(np.uint32).tobytes()].add(int(rng.integers(0, 4)))
    keys = sorted(rows)
    cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([min(rows[k]) for k in keys]),
            pa.array([max(rows[k]) for k in keys]), pa.array(["after"] * len(keys)), pa.array([k[0] for k in keys]),
            pa.array(range(len(keys)))]
    batch = pa.RecordBatch.from_arrays(cols, ["g", "words", "lo", "hi", "side", "component_id", "h"])
    got = {}
    for out in substring_dedup._longest_shared([batch.slice(i, 7) for i in range(0, len(keys), 7)]):
        got.update(zip(out.column(2).to_pylist(), out.column(3).to_pylist()))

    def same(a, b):
        a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i, k in enumerate(keys):
        want = max(same(k[1], o[1]) for o in keys if o[0] == k[0] and (rows[o] | rows[k]) > {min(rows[k])})
        assert got.get(i, 0) == want


def test_substring_ends_meet_any_holder(spark):
    rng = np.random.default_rng(12)
    rows, want = [], set()
    for i in range(20):
        passage = prose(54, rng)
        w = passage.split()
        rows += [(100 * i + 50, prose(30, rng) + " " + passage + " " + prose(30, rng)),
                 (100 * i + 51, prose(30, rng) + " " + passage + " " + prose(30, rng))]
        # smaller documents that hold the passage's paragraphs, each amid other words
        rows += [(100 * i + j, prose(30, rng) + " " + " ".join(w[a:a + 24]) + " " + prose(30, rng))
                 for j, a in enumerate((0, 10, 20, 30))]
        want |= {100 * i + 50, 100 * i + 51}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == want


def test_substring_finds_every_shared_run(spark):
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for i in range(60):
        period = (1, 2, 4, 5, 100)[i % 5]  # repeated words, and plain passages
        w = [f"w{i}x{j % period}" for j in range(50 + i % 11)]
        for d in (2 * i, 2 * i + 1):
            before, after = (["b%d.%d.%d" % (d, j, rng.integers(1000)) for j in range(70)] for _ in range(2))
            rows.append((d, "é " + " ".join(before + w + ["ñ"] + after)))
            want[d] = " ".join(w + ["ñ"])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring_dedup.repeated_passages(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(want) and out.count() == len(want)
    text = dict(rows)
    for d, r in got.items():
        cut = text[d][r["start"]: r["stop"]]
        assert r["n_words"] >= 50 and (r["n_paragraphs"] or (cut == want[d] and r["n_words"] == len(cut.split())))
        assert r["removed"] == bool(d % 2) and r["first_doc"] == d - d % 2


def test_word_runs_have_a_common_fingerprint():
    h = RNG.integers(0, 1 << 62, 300, dtype=np.uint64)
    row = np.repeat([0, 1, 2], [30, 150, 120])
    at, fp, run = substring_dedup.word_runs(h, row, 50)
    assert at.tolist() == [*range(30, 131), *range(180, 251)]
    again, fp2, run2 = substring_dedup.word_runs(h[100:150], np.zeros(50, int), 50)
    i = at.tolist().index(100)
    assert again.tolist() == [0] and fp[i] == fp2[0] and run[i] == run2[0]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "assistant", "\\1 <|end|>\n"), (1, 3, "assistant", "|><"),
            (2, 5, None, "x"), (2, 4, "a|b<", ""), (3, 0, "assistant", "\\### Assistant: </turn> ok"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [(r, x) for _, r, x in own]
        assert got[c]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
    assert got[1]["formatted"].count("<|role:") == 2
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_embeddings(spark):
    x = RNG.normal(size=(40, 16))
    near = x[:20] + RNG.normal(size=(20, 16)) * 0.03
    v = np.concatenate([x, near, x[:3]])
    rows = [(i, [float(c) for c in vec], int(i % 2 == 0 or i >= 0)) for i, vec in enumerate(v)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] + [1.0] * 15, 1), (103, rows[0][1], None),
             (104, rows[0][1][:8], 1), (105, [None] + rows[0][1][1:], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if unit[i] @ unit[j] >= 0.98]
    want = clusters(range(len(v)), link)
    degree = collections.Counter(i for e in link for i in e)
    for block in (4096, 8):
        got = {r["id"]: r for r in embedding_dedup.near_duplicates(df, scale=3.0, block=block).collect()}
        assert all((got[i]["n_links"], got[i]["component_id"]) == (degree[i], want[i]) for i in range(len(v)))
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(100, 106))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [8, 16, 64])
def test_embeddings_by_default_in_any_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    v = np.concatenate([x, 0.9801 * x + np.sqrt(1 - 0.9801 ** 2) * side])
    df = spark.createDataFrame([(i, [float(c) for c in vec], 1) for i, vec in enumerate(v)],
                               "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    got = {r["id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(v))] == want.tolist() and want.min() >= 1


def test_embedding_scale_of_64_dimensions_is_unchanged():
    assert abs(embedding_dedup.scale_of(64, 0.98) - 5.0) < 1e-9


def test_lattice():
    x = RNG.normal(size=(500, 8)) * 3
    p = embedding_dedup.nearest_e8(x)
    other = p[:, None] + embedding_dedup.shortest_vectors()[None]
    assert (((x[:, None] - other) ** 2).sum(2).min(1) >= ((x - p) ** 2).sum(1) - 1e-9).all()
    assert np.allclose(embedding_dedup.nearest_e8(p), p)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/1?x", "https://www.example.com/en/2#y", "http://x.com", "http://x.com/a",
            "ftp://notexample.com/en/", "http://b.org/p/1.html", "http://b.org?q=/en/"]
    bad = [("http://spam.net/buy/%d" % i, True) for i in range(40)] + [("http://fine.net/read/%d" % i, False) for i in range(40)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate([(u, None) for u in urls] + bad + [("http://spam.net/buy/999", None)])],
                               "page_id long, url string, bad boolean").withColumn("_host", F.lit("h"))
    out = url_filter.judge_urls(df, RULES)
    assert out.columns == [*df.columns, "_url"]
    got = {r["page_id"]: r["_url"] for r in out.collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(9)] == [
        ("", "", None), ("", "", None), ("a.example.com", "/en/1", "example.com/en/"),
        ("www.example.com", "/en/2", "www.example.com/en/"), ("x.com", "", None), ("x.com", "/a", "com/"),
        ("notexample.com", "/en/", "com/"), ("b.org", "/p/1.html", None), ("b.org", "", None)]
    assert got[2]["verdict"] == "block" and got[6]["verdict"] == "allow"
    assert got[89]["verdict"] == "block" and got[50]["verdict"] == "allow" and got[89]["template"].startswith("spam.net/")
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0


def test_templates_of_one_host_are_judged_apart(spark):
    """One host: a section of mostly bad urls, one of mostly good ones, a thin one; every row twice."""
    rows = ([(f"http://one.net/casino/{i}", i % 10 != 0) for i in range(60)]
            + [(f"http://one.net/wiki/{i}", i % 10 == 0) for i in range(60)]
            + [("http://one.net/casino/7777", None), ("http://one.net/wiki/7777", None), ("http://one.net/thin/a", True)])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] * 2, "page_id long, url string, bad boolean")
    got = url_filter.judge_urls(df, RULES).select("url", "_url.verdict").collect()
    assert len(got) == 2 * len(rows)
    assert {r["verdict"] for r in got if "/casino/" in r["url"]} == {"block"}
    assert {r["verdict"] for r in got if "/casino/" not in r["url"]} == {"allow"}


def test_labels_without_signal_reject_nothing(spark):
    rows = [(i, f"http://h{i % 5}.net/s{i % 3}/{i}", i % 4 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    assert url_filter.judge_urls(df, RULES).where("_url.verdict = 'block'").count() == 0


def test_language(spark, docs, empty):
    rng = np.random.default_rng(1)
    sounds = {"aa": ["ka", "lu", "mi"], "bb": ["sch", "er", "ung"], "cc": ["eau", "oi", "que"]}
    rows = [(lang, " ".join("".join(rng.choice(s, 3)) for _ in range(20))) for lang, s in sounds.items() for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.fit(df.limit(120).union(df.limit(1).select(F.lit(None).cast("string"), "text")))
    model = language_id.fit(df)
    out = language_id.predict(df, model).collect()
    assert np.mean([r["lang"] == r["_lang"]["lang"] for r in out]) > 0.98
    got = {r["doc_id"]: r["_lang"] for r in language_id.predict(docs, model).collect()}
    assert {i for i, r in got.items() if r["lang"] == "und"} == {0, 1, 2, 15}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.fit(df.limit(0))
    assert {r["_lang"]["lang"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 5, 9, 20, 65, 1000):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
        apart = [(code[i] != code[j]).sum() for i in range(min(n, 70)) for j in range(i)]
        assert min(apart) >= (1 if n < 6 else code.shape[1] // 8)


def test_any_number_of_languages(spark):
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(97, 123)]
    sounds = ["".join(rng.choice(letters, 3)) for _ in range(400)]
    own = {f"l{i:02d}": rng.choice(sounds, 6) for i in range(70)}
    rows = [(lang, " ".join("".join(rng.choice(s, 2)) for _ in range(40))) for lang, s in own.items() for _ in range(6)]
    df = spark.createDataFrame(rows + [("only null text", None), ("l00", rows[0][1])], "lang string, text string")
    model = language_id.fit(df)
    assert len(model.langs) == 71 and model.langs == sorted(model.langs)
    got = language_id.predict(df.withColumn("_lang", F.lit(1)).where("text IS NOT NULL"), model, out="found").collect()
    assert np.mean([r["lang"] == r["found"]["lang"] for r in got]) > 0.98 and {r["_lang"] for r in got} == {1}


def test_language_weights_equal_those_of_dense_counts(spark):
    rows = [("aa", "ka lu mi ka"), ("bb", "sch er ung"), ("cc", "eau oi que oi"), ("aa", "mi mi lu")]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    counts = np.zeros((3, language_id.DIM))
    for lang, text in rows:
        for order in language_id.ORDERS:
            np.add.at(counts[["aa", "bb", "cc"].index(lang)], language_id.ngrams(np.frombuffer(text.encode(), np.uint8), order), 1)
    share = (counts + language_id.SMOOTHING) / (counts.sum(1, keepdims=True) + language_id.SMOOTHING * language_id.DIM)
    code = model.code
    for b in range(code.shape[1]):
        side = code[:, b] > 0
        want = np.clip(np.log(share[side].mean(0) / share[~side].mean(0)), -language_id.CLIP, language_id.CLIP)
        assert np.allclose(model.weights[:, b], want, atol=1e-5)


def test_a_very_long_text_has_the_language_of_its_parts(spark):
    rows = [("aa", "ka lu mi " * 30), ("bb", "sch er ung " * 30)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    long = spark.createDataFrame([(0, "sch er ung " * 200_000), (1, None), (2, ""), (3, "ka lu mi"), (3, "ka lu mi")],
                                 "doc_id long, text string")
    got = [(r["doc_id"], r["_lang"]["lang"]) for r in language_id.predict(long, model).collect()]
    assert sorted(got) == [(0, "bb"), (1, "und"), (2, "und"), (3, "aa"), (3, "aa")]


def test_bpe(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    more = ["don't 'sun we'll 'll''s <|endoftext|>x<|startoftext|>", "abc" * 3000, "!" * 500 + "Ας ΣΑΣ é", "\x1c\x85x y ½Ⅷ"]
    spark = docs.sparkSession
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "a long, b string"))
    for size in (0, 50):
        codec = bpe_codec.build_codec(df, path, lexicon_size=size)
        for r in codec.decode(codec.encode(codec.round_trip(df))).collect():
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["_ids"] == ids == r["_bpe"]["ids"]
            assert r["_decoded"] == lib.decode(ids, skip_special_tokens=False) == r["_bpe"]["decoded"]
    assert bpe_codec.build_codec(empty, path).encode(empty).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words_ = sorted({w for w in prose(800).split()})
    entries = {w.encode(): (i, i * 7) for i, w in enumerate(words_)}
    arrays = bpe_codec.compile_lexicon(entries)
    bpe_codec.write_lexicon(arrays, str(tmp_path / "x"))
    lex = bpe_codec.Lexicon(str(tmp_path / "x"))
    assert lex.look_up([*entries, b"zzz", b"", words_[0].encode() + b"zq"]) == [*entries.values(), None, None, None]
    assert len(arrays["final"]) < sum(map(len, words_)) / 2  # shared prefixes and suffixes


def test_lm(docs, empty):
    df = docs.withColumn("train", F.col("doc_id") % 4 != 0)
    counts = collections.Counter()
    for i, t in [*enumerate(TEXTS), (5, BASE)]:
        if i % 4:
            counts.update(words(t) + ["</s>"])
    n, v = sum(counts.values()), len(counts)
    for head in (1 << 17, 20):
        for r in lm_scoring.score(df, head=head, pair_head=head, outputs=16, steps=20).collect():
            text = BASE if r["id"] is None else TEXTS[r["id"]]
            tok = words(text) + ["</s>"]
            base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tok), sum(counts[w] > 0 for w in tok), n)
            assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert lm_scoring.score(empty.withColumn("train", F.lit(True))).count() == 0


def test_lm_probabilities_are_normalised_and_learn():
    pairs = np.zeros((4, 3))
    pairs[0, 1], pairs[1, 2], pairs[2, 0], pairs[3] = 90, 80, 70, [10, 10, 10]
    p = 10 ** lm_scoring.normalised(lm_scoring.train(pairs, dim=8, steps=200)).astype(float)
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    assert p[0].argmax() == 1 and p[1].argmax() == 2 and p[2].argmax() == 0 and p[0, 1] > 0.9


def test_mean_seeded_hash_is_stable():
    data = np.frombuffer(b"A word\nand a Word", np.uint8)
    h, *_ = common.token_hashes(data, np.array([0, len(data)]), common.WHITE)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert hashlib.sha256(b"").hexdigest()


def test_pieces_of_several_documents_are_no_passage(spark):
    rng = np.random.default_rng(11)
    rows, stitched = [], []
    for case in range(20):
        b, c = ([f"w{case}x{n}" for n in rng.integers(0, 10 ** 9, 30)] for _ in range(2))
        own = lambda n: [f"u{x}" for x in rng.integers(0, 10 ** 9, n)]
        rows += [(case * 10, " ".join(own(80) + b + own(80))), (case * 10 + 1, " ".join(own(80) + c + own(80))),
                 (case * 10 + 2, " ".join(own(80) + b + c + own(80)))]
        stitched.append(case * 10 + 2)
    whole = [f"v{x}" for x in rng.integers(0, 10 ** 9, 70)]
    rows += [(900, " ".join(whole)), (901, " ".join(["a", *whole, "z"]))]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {900, 901}
