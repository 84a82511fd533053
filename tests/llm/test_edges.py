"""Every operator on nulls, blanks, ties, repeated rows, very long texts, empty tables, clashing columns."""

import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard_join, language_id, licenses, lm_scoring, mixing, quality_classifier, quality_rules, substring_dedup, url_filters

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"common{i}" for i in range(70))
ROWS = [
    (1, "The cat sat on the mat and looked at the moon over the hill " * 3, "en", "a", 10),
    (2, "The cat sat on the mat and looked at the moon over the hill " * 3, "en", "a", 10),
    (2, "The cat sat on the mat and looked at the moon over the hill " * 3, "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "de", "b", 4),
    (6, "one two", "de", None, 7),
    (7, LONG, "en", "c", 1),
    (8, PASSAGE + " tail", "en", "é", 1),
    (9, "head " + PASSAGE, "en", "c", 1),
    (None, "head " + PASSAGE, "en", "c", 1),
    (None, None, None, None, None),
    (10, "1234 5678 !!! ***", "fr", "a", 2),
    (11, "Under the MIT license, under the Apache License, version 2.0 and CC BY-NC 4.0", "en", "a", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_row", "id", "th", "size", "score", "host", "x", "e", "n", "y", "_text", "seed", "_doc", "_w", "words", "copies", "predicted", "key", "pos"]
LABELS = [(1, 1, 0), (2, 1, 0), (6, 0, 0), (10, 0, 1), (7, 1, 0), (3, None, None), (None, 1, 1), (10, 0, 1)]
BENCH = [(1, PASSAGE), (2, PASSAGE), (3, None), (None, "tiny"), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside; plain tables are in test_contracts.py."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def ops(docs, labels, bench):
    langs, model = language_id.train(docs)
    quality = quality_classifier.train(docs, labels)
    return {
        "lm": lm_scoring.lm_score(docs, docs),
        "lang": language_id.predict(docs, langs, model),
        "decontaminate": decontaminate.decontaminate(docs, bench),
        "mix": mixing.mix(docs),
        "licenses": licenses.license_scan(docs),
        "rules": quality_rules.quality_rules(docs, labels),
        "substring": substring_dedup.substring_dedup(docs),
        "quality": quality_classifier.score(docs, quality),
        "jaccard": jaccard_join.shingle_components(docs),
    }


def test_every_row_gets_its_result(spark, docs, labels, bench):
    for name, df in ops(docs, labels, bench).items():
        got = df.collect()
        if name == "decontaminate":
            assert {(r.doc_id, r.item_id) for r in got} == {(8, 1), (9, 1), (None, 1)}
            assert all(r.n_equal == 70 for r in got)
            continue
        assert len(got) == len(ROWS), name
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS), name
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        assert by[2][0] == by[2][1], name
        if name == "jaccard":
            assert by[1][0].component_id == by[2][0].component_id == 1
            assert by[9][0].component_id == 8 and {r.component_id for r in by[None]} == {8, None}  # 70 of 72 shingles
            assert by[4][0].component_id == 4 and by[5][0].n_shingles == 0 and by[6][0].n_shingles == 1
        if name == "substring":
            assert by[1][0].n_removed == 0 and by[9][0].n_removed == 70 and by[8][0].n_removed == 0
            assert by[9][0].kept.strip() == "head" and by[9][0].removed[0].first == 1 and by[9][0].removed[0].n == 70
            assert by[7][0].kept == LONG and by[3][0].kept == ""
        if name == "lang":
            assert by[3][0].lang_pred == "und" and by[5][0].lang_pred == "und" and by[10][0].lang_pred == "und" and by[7][0].lang_pred == "en"
        if name == "licenses":
            assert by[11][0].base_labels == "apache-2,cc-by-nc,mit" and by[11][0].n_base == 3 and by[11][0].first_word == 0
            assert by[3][0].n_words == 0 and by[3][0].labels == "" and by[3][0].first_word is None
        if name == "rules":
            assert by[3][0].n_words == 0 and by[3][0].base_failed and not by[3][0].kept
            assert by[1][0].n_repeat_words == 42 and by[7][0].n_repeat_words == 0
        if name == "lm":
            assert by[3][0].n_tokens == 1 and by[7][0].n_tokens == 60_001
            assert all(r.score < 0 and r.base_score < 0 for r in got)
        if name == "mix":
            assert sum(r.taken for r in got) > 0 and by[3][0].taken == 0 and all(r.taken <= 2 * r.size for r in got)
        if name in ("quality", "lang"):
            assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    docs, labels, bench = (spark.createDataFrame([], s) for s in (SCHEMA, "doc_id long, quality int, toxic int", "item_id long, text string"))
    for name, df in ops(docs, labels, bench).items():
        assert df.collect() == [], name
    full = spark.createDataFrame(ROWS[:6], SCHEMA)
    assert quality_classifier.score(full, quality_classifier.train(full, labels)).filter("score = 0.5").count() == 6
    assert decontaminate.decontaminate(full, bench).count() == 0
    assert language_id.predict(full, *language_id.train(docs)).filter("lang_pred = 'und'").count() == 6
    assert quality_rules.quality_rules(full, labels).filter("llr <> 0").count() == 0
    assert lm_scoring.lm_score(full, docs).filter("n_known = 0").count() == 6


def test_stages_keep_columns(spark, docs, labels, bench, tmp_path):
    docs.sparkSession.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for module in (quality_classifier, jaccard_join, substring_dedup, decontaminate):
        out = module.stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, module
        assert out.count() <= len(ROWS)
    out = mixing.stage(spark, docs, str(tmp_path))
    assert {"copies", "taken", "text"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert out.count() >= 1


def test_url_edges(spark):
    rows = [(1, "http://A.Bad.example/x", "2024-01-01"), (2, None, "2024-01-01"), (3, "not a url", "2024-01-01"), (4, "https://bad.example/ok/1", None), (5, "https://bad.example:80/ok/1", "2024-01-01"), (5, "https://bad.example:80/ok/1", "2024-01-01"), (6, "https://u@bad.example./", "2023-12-31")]
    listed = [("bad.example", "c", "block", "add", "2024-01-01"), ("bad.example/ok", "c", "allow", "add", "2023-01-01"), (None, "c", "block", "add", "2023-01-01"), ("bad.example", "d", "block", "add", None), ("a.bad.example", "z", "block", "add", "2024-01-01"), ("a.bad.example", "z", "block", "remove", "2024-01-01")]
    df = spark.createDataFrame(rows, "page_id int, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched")).withColumns({"host": F.lit("old"), "_row": F.lit(1)})
    got = sorted(url_filters.filter_urls(df, url_filters.entries(spark, tuple(listed))).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.blocked) for r in got] == [(1, True), (2, False), (3, False), (4, False), (5, False), (5, False), (6, False)]
    assert got[0].decided_by == "a.bad.example" and got[4].decided_by == "bad.example/ok" and got[0].categories == "c,z"
    assert got[0]["_row"] == 1
    assert url_filters.filter_urls(df.limit(0), url_filters.entries(spark, tuple(listed))).count() == 0
    kinds = [("=bad.example", "host", "block", "add", "2023-01-01"), ("=bad.example/ok/1", "page", "block", "add", "2023-01-01"), ("bad.example/ok", "part", "allow", "add", "2023-01-01")]
    got = {r.page_id: (r.decided_by, r.categories) for r in url_filters.filter_urls(df, url_filters.entries(spark, tuple(kinds))).collect()}
    assert got[5] == ("=bad.example/ok/1", "host,page,part") and got[6] == ("=bad.example", "host") and got[1] == (None, "")
    drawn = url_filters.drawn_list(df)
    assert drawn.filter("action = 'remove'").count() <= drawn.filter("action = 'add'").count()
    assert url_filters.filter_urls(df, drawn).count() == url_filters.filter_urls(df, drawn.limit(0)).count() == len(rows)


def test_fold_is_the_contracts(spark):
    got = spark.range(50).select("id", language_id.fold("id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)
