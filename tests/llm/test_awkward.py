"""Awkward inputs of the operators and of the pipeline: nulls, empty tables, repeated rows, clashing columns, very long texts."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from segmentry.llm import common, language, pages, quality, secrets, vectors

RND = random.Random(17)
WORDS = ["".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RND.randint(2, 8))) for _ in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def test_vectors_of_an_empty_table_and_of_one_row(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = vectors.near_duplicates(spark.createDataFrame([(7, [1.0, 0.0], 1), (8, None, None)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(7, 0, 7, True), (8, 0, 8, True)]


def test_dense_label_is_found_around_its_mean(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(32)
    centre /= np.linalg.norm(centre)

    def offset(n):
        r = rng.standard_normal((n, 32))
        r -= np.outer(r @ centre, centre)
        return r / np.linalg.norm(r, axis=1)[:, None]

    x = np.sqrt(.94) * centre + np.sqrt(.06) * offset(2_000)
    p = offset(100)
    p -= (p * x[:100]).sum(axis=1)[:, None] * x[:100]
    y = .985 * x[:100] + np.sqrt(1 - .985 ** 2) * p / np.linalg.norm(p, axis=1)[:, None]
    x = np.concatenate([x, y])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= .98
    np.fill_diagonal(near, False)
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    got = {r[0]: r[1] for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got.values()) >= 0.95 * near.sum() and all(got[i] <= near[i].sum() for i in got)


def test_very_long_texts(spark):
    long = " ".join(WORDS * 600)  # over a megabyte
    key = "AKIA" + "Z9" * 10
    rows = [(1, long + f" {key}", "en", "a", len(long)), (2, prose(40), "en", "a", 9), (3, prose(40), "fr", "b", 9), (4, long, "en", "a", 9)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (None, 0)], "doc_id long, quality int")
    assert quality.score(docs, labels).count() == 4
    assert {r["language"] for r in language.identify(docs).collect() if r["doc_id"] in (1, 4)} == {"en"}
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert (1, len(long) + 1, len(long) + 25) in spans[1] and (2, 0, 0) not in spans[4]
    page = f"<body><nav>menu</nav><article><p>{long}</p></article></body>"
    got = pages.main_text(spark.createDataFrame([(1, "http://a.b/", page), (2, None, None)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {1: long, 2: ""}


def test_language_of_pages(spark, tmp_path):
    words = {"en": ["the", "house", "which", "thing"], "de": ["das", "schöne", "haus", "nicht"], "fr": ["le", "château", "très", "où"]}
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(RND.choice(words[lang]) for _ in range(40))
        markup = f" lang='{lang}'" if i % 2 else ""
        rows.append((i, f"http://h{i % 6}.example.{lang if i % 5 else 'com'}/x", f"<html{markup}><body><p>{text}</p></body></html>"))
    rows += [(100, None, None), (101, "nonsense", ""), (102, "http://h0.example.de/", "<html lang=de><body>123</body></html>"), rows[0]]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = language.language_of_pages(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["language"] == ("en", "de", "fr")[i % 3] and by[i]["kept"] for i in range(90))
    assert all(by[i]["language"] is None and not by[i]["kept"] for i in (100, 101, 102))


def test_pipeline_of_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    base, item = prose(120), prose(20)
    rows = [(1, base, "en", "a", 9), (2, base, "en", "b", 9), (2, base, "en", "b", 9), (3, prose(60) + " " + item + " " + prose(60), "en", "a", 9),
            (4, None, None, None, None), (5, "", "en", "a", 0), (None, prose(50), "en", "a", 9), (6, prose(90) + " password = hunter2hunter2", "en", None, 9)]
    rows += [(10 + i, prose(60), "en", f"s{i % 3}", 9) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("node", "row", "label", "cluster", "place", "h", "digest", "ids", "found", "__key"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = common.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, given, str(tmp_path)).columns == given.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert {1, 6, None, *range(10, 40)} <= set(ids) and not {2, 3, 4, 5} & set(ids)
    assert "hunter2" not in next(r["decoded"] for r in out if r["doc_id"] == 6)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
