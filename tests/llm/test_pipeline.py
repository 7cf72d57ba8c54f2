"""The pipeline against a brute-force version of its stages, on a few documents."""

import pytest

import corpus_pipeline as cp


def test_pipeline(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    en = "the house and the garden are near the river where old friends often meet for a walk number"
    rows = [(i, f"{en} {chr(97 + i)}{i} and more about {chr(110 - i)} things\nthis boilerplate line is everywhere",
             "en", "s", 0) for i in range(6)]
    rows += [(10, rows[0][1], "en", "s", 0), (11, "123 456 !!", "en", "s", 0), (12, None, "en", "s", 0),
             (13, "x " + "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " + en, "en", "s", 0),
             (14, "le chat et la souris sont dans la maison avec les enfants qui jouent", "fr", "s", 0)]
    rows += [(20, en + " with an ending of its own\nOf.", "en", "s", 0), (21, en + " with an ending of its own\nOf.", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen")],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination",
                                        "bpe_encoding"]
    kept = cp.identify_language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {r[0] for r in rows} - {11, 12}
    kept = cp.dedup_lines(spark, kept, str(tmp_path))
    text = {r["doc_id"]: r for r in kept.collect()}
    assert 20 in text and 21 not in text  # of a copy only a scrap remains: it goes
    assert 10 not in text and text[0]["text"].endswith("everywhere") and "\n" not in text[1]["text"]
    assert all(r["n_chars"] in (0, len(r["text"])) for r in text.values())
    out = cp.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert 13 not in ids and {0, 14} <= ids
    lib = tokenizers.Tokenizer.from_file(cp.tokenizer_path())
    for r in out:
        want = lib.encode(text[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)


def test_clashing_names_nulls_and_empty_tables(spark, tmp_path):
    text = "the house and the garden are near the river where old friends often meet"
    docs = spark.createDataFrame([(1, text, "en", "s", 9, "a", 1, 2), (1, text, "en", "s", 9, "a", 1, 2),
                                  (None, text + " again\nand again here", "en", None, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long, _lang string, "
                                 "_lines int, doc int")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in cp.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.schema.names == docs.schema.names
            assert [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == (["1", "1", "None"] if table is docs else [])
        assert {(r["_lang"], r["_lines"], r["doc"]) for r in kept.collect()} <= {("a", 1, 2), (None, None, None)}
