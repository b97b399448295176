"""Edge cases of feeds, coercion, text, scores, names and replies."""

import json

import pytest
from pyspark.sql import functions as F

from segmentry import contracts
from segmentry.functions import columns as C
from segmentry.functions import text as X
from segmentry.operators import evidence, market, naming, reviews, rows, scoring
from segmentry.operators import tfidf as T
from segmentry.sources import feeds, tables


# ---------------------------------------------------------------- feeds

def chart(spark, entry, strict=False):
    doc = json.dumps({"feed": {"entry": entry} if entry is not None else {}})
    docs = spark.createDataFrame([(doc, "top_free", "u", "2024-01-01")],
                                 "doc string, chart_type string, source_url string, snapshot_date string")
    return feeds.chart_entries(docs, strict)


def test_lone_chart_entry_and_missing_image(spark):
    entry = {"id": {"attributes": {"im:id": "7"}, "label": "http"}, "im:name": {"label": "N"}}
    row = chart(spark, entry).first()
    assert (row["chart_position"], row["app_id"], row["title"], row["artwork_url"]) == (1, "7", "N", None)


def test_last_image_and_positions(spark):
    entry = [{"im:image": [{"label": "a"}, {"label": "b"}]}, {"im:image": []}]
    assert [(r["chart_position"], r["artwork_url"]) for r in chart(spark, entry).collect()] == [(1, "b"), (2, None)]


def test_absent_and_malformed_chart_entries(spark):
    assert chart(spark, None).count() == 0
    assert chart(spark, "text").count() == 0
    with pytest.raises(Exception, match="unexpected feed format"):
        chart(spark, "text", strict=True).collect()
    with pytest.raises(ValueError, match="no chart data"):
        feeds.append_charts([chart(spark, None)], check=True)


def page(spark, entries, page_number=1, app="a"):
    doc = json.dumps({"feed": {"entry": entries}}) if entries is not None else None
    return spark.createDataFrame([(app, "g", "d", page_number, doc)],
                                 "app_id string, game_title string, developer string, page_number int, doc string")


def review(rating, text="fine game", **more):
    return {"im:rating": {"label": rating}, "content": {"label": text}, **more}


def test_review_ratings_and_missing_text(spark):
    entries = [review("4.9"), review("0"), review("6"), review("x"), review("0.9"), review("5.9"), review("3d"),
               {"im:rating": {"label": "3"}}, {"im:rating": {"label": "3"}, "content": "plain"}]
    assert [r["review_rating"] for r in feeds.review_rows(page(spark, entries)).collect()] == [4, 5]
    assert feeds.review_page_entries(page(spark, entries)).select(F.size("entries")).first()[0] == 8


def test_review_list_with_other_values(spark):
    entries = ["note", None, [1], review("2", author={"name": {"label": "Al"}})]
    row = feeds.review_rows(page(spark, entries)).first()
    assert (row["review_rating"], row["reviewer"]) == (2, "Al")
    assert feeds.page_facts(page(spark, entries)).first()["entry_count"] == 1
    assert feeds.review_rows(page(spark, review("5"))).count() == 1


def test_lookup_record(spark):
    record = {"trackId": 12, "genres": "none", "features": [], "price": 0.99, "averageUserRating": "bad",
              "releaseDate": "2024-01-02T03:04:05Z", "supportedDevices": ["x", "y"]}
    row = feeds.lookup_records(spark.createDataFrame([(json.dumps(record),)], "doc string")).first()
    assert (row["app_id"], row["detailed_genres"], row["has_in_app_purchases"]) == ("12", "", False)
    assert (row["price"], row["average_rating"], row["supported_devices"]) == (0.99, None, "x | y")
    assert row["release_date"].isoformat() == "2024-01-02T03:04:05"
    assert len(row) == 26


def cutoff(spark, pages, **options):
    facts = spark.createDataFrame(pages, "app_id string, page_number int, failed boolean, entry_count int, parsed_count int")
    return {r["app_id"]: (r["reviews_collected"], r["pages_collected"], r["request_failed"])
            for r in feeds.collection_coverage(feeds.page_cutoff(facts, **options), options.get("max_reviews")).collect()}


def test_page_cutoff(spark):
    full = [("full", p, False, 50, 50) for p in range(1, 8)]
    short = [("short", 1, False, 50, 45), ("short", 2, False, 39, 39), ("short", 3, False, 50, 50)]
    gone = [("gone", 1, False, 50, 50), ("gone", 2, True, 0, 0), ("gone", 3, False, 50, 50)]
    gap = [("gap", 2, False, 50, 50)]
    empty = [("empty", 1, False, 0, 0), ("empty", 2, False, 50, 50)]
    out = cutoff(spark, full + short + gone + gap + empty)
    assert out == {"full": (250, 5, False), "short": (84, 2, False), "gone": (50, 1, True),
                   "gap": (0, 0, True), "empty": (0, 0, False)}
    assert cutoff(spark, full, max_reviews=50) == {"full": (50, 0, False)}
    assert cutoff(spark, full, max_reviews=120) == {"full": (120, 2, False)}
    assert cutoff(spark, full, max_reviews=50, count_capped_page=True) == {"full": (50, 1, False)}


# ---------------------------------------------------------------- coercion and contracts

def test_ids_and_numbers(one):
    assert one("a string, b string", ("123.0", "1.05"), C.normalize_id(F.col("a")), C.normalize_id(F.col("b"))) == ("123", "15")
    assert one("a string, b string, c string", ("abc", "", "7"), *[C.to_number(F.col(x)) for x in "abc"]) == (None, None, 7.0)
    assert one("a string", (None,), C.normalize_id(F.col("a"))) is None


def test_round_half_even(one):
    assert one("a double, b double", (0.25, 2.5), C.round_even(F.col("a"), 1), C.round_even(F.col("b"), 0)) == (0.2, 2.0)


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="missing required columns: x, z"):
        contracts.require_columns(df, ["z", "k", "x"])
    with pytest.raises(ValueError, match="not unique"):
        contracts.assert_unique(df, ["k"])
    with pytest.raises(ValueError, match="too few usable rows: 2, need 20"):
        contracts.require_rows(df, 20)
    with pytest.raises(ValueError, match="metadata is not unique"):
        tables.enrich(df.withColumnRenamed("k", "app_id"), spark.createDataFrame(
            [("1", "d"), ("1", "e")], "app_id string, description string"), check=True)


def test_tables_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi",\nthere', "x")], "app_id string, title string, n string")
    path = str(tmp_path / "csv")
    tables.write_table(df.coalesce(1), path, csv=True)
    row = tables.read_csv(spark, path, "app_id string, title string, n int", ["app_id"]).first()
    assert (row["title"], row["n"]) == ('say "hi",\nthere', None)
    with pytest.raises(ValueError, match="missing required columns: price"):
        tables.read_csv(spark, path, "app_id string", ["price"])
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    assert tables.latest_file(spark, path, header=True, multiLine=True, escape='"').count() == 1
    snaps = str(tmp_path / "snaps")
    for ts, n in (("20240101_000000", 3), ("20240102_000000", 2), ("20240102_000000", 1)):
        tables.append_snapshot(spark.range(n), snaps, ts)
    assert spark.read.parquet(snaps).count() == 4
    assert tables.latest_snapshot(spark.read.parquet(snaps)).count() == 1


def test_bundle(spark, tmp_path):
    from segmentry.schemas import TABLES
    for name, (schema, _) in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    assert set(tables.load_bundle(spark, str(tmp_path))) == set(TABLES)


def test_review_validity_bounds(spark):
    data = [(i, "a", "r", t, r, None) for i, (t, r) in enumerate(
        [("four", "3"), ("fiver", "3"), ("valid", "0"), ("valid", "1"), ("valid", "5"), ("valid", "6"), ("valid", "x")])]
    df = spark.createDataFrame(data, "i int, app_id string, review_id string, review_text string, review_rating string, review_date string")
    assert [r["i"] for r in reviews.valid_reviews(df).orderBy("i").collect()] == [1, 3, 4]


def test_first_per_chart(spark):
    df = spark.createDataFrame([("1.0", "f", 2), ("1", "f", 1), ("1", "p", 5)], "app_id string, chart_type string, chart_position int")
    assert {tuple(r) for r in tables.chart_keys(df).collect()} == {("1", "f", 1), ("1", "p", 5)}


def test_number_rows_and_batches(spark):
    df = spark.range(0, 1003).select(((F.col("id") * 7919) % 1003).alias("id"))
    out = rows.number_rows(df, ["id"], "n", partitions=7).collect()
    assert sorted((r["id"], r["n"]) for r in out) == [(i, i + 1) for i in range(1003)]
    batches = rows.id_batches(df, "id", ["id"], 25).orderBy("batch_id").collect()
    assert [r["ids"] for r in batches] == [list(range(i, min(i + 25, 1003))) for i in range(0, 1003, 25)]


# ---------------------------------------------------------------- text

@pytest.mark.parametrize("raw, expected", [
    ("GAME game Merge merge-  http://x.y <b>Cook</b> a@b.co 3D", "merge cook"),
    (None, ""), ("--foo-- a-b ab- -ab", "foo a-b"), ("www.a.b tail", "tail"), ("école d'été cafés", "cole caf"),
    ("fun word word fun word", "word"),
])
def test_clean_description(one, raw, expected):
    assert one("a string", (raw,), X.clean_description(F.col("a"))) == expected


@pytest.mark.parametrize("raw, expected", [
    ("Don't like THIS app!! www.x.y", "don't this"), (None, ""), ("'quoted' -- it's it's", "quoted it's it's"),
])
def test_clean_review(one, raw, expected):
    assert one("a string", (raw,), X.clean_review(F.col("a"))) == expected


def test_small_text_functions(one):
    a = F.col("a")
    assert one("a string", ("Games|Puzzle|Family",), X.genre_terms(a)) == "puzzle family puzzle family"
    assert one("a string", (None,), X.genre_terms(a)) == ""
    assert one("a string", (None,), C.split_list(a)) == []
    assert one("a string", ("a | | b",), C.split_list(a)) == ["a", "b"]
    assert one("a string", ("role-playing it's",), X.title_case(a)) == "Role-Playing It'S"
    assert one("a string", ("x" * 250,), X.clip_example(a)) == "x" * 250
    assert one("a string", ("x" * 251,), X.clip_example(a)) == "x" * 247 + "..."
    assert one("a string", ("",), X.complaint_label(a)) == "Player complaint"
    assert one("a string", ("ads crash | slow | pay | no",), X.complaint_label(a)) == "Ads Crash / Slow / Pay"


def test_vocabulary_limits(spark):
    texts = ["alpha beta gamma", "alpha beta delta", "alpha gamma beta", "alpha omega"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    profile = T.Profile(T.CATALOG.token_pattern, min_df=3, max_df=0.8, max_features=10, stopwords=("the",))
    vocab = T.vocabulary(T.term_counts(docs, "id", "t", profile), docs, profile).collect()
    # gamma is in two documents only, alpha in all four
    assert [(r["term"], r["df"]) for r in vocab] == [("beta", 3)]


def test_tfidf_rows_have_length_one(spark, folder):
    from segmentry.workload.text import corpus
    weights = T.tfidf(corpus(spark, folder), "doc_id", "cleaned_text", T.COHERENCE)
    lengths = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("q"))
    assert lengths.filter(F.abs(F.col("q") - 1) > 1e-9).count() == 0


def test_coherence_of_single_and_empty(spark):
    docs = spark.createDataFrame([(1, 0, "aa bb"), (2, 1, "aa bb"), (3, 1, "aa bb"), (4, 2, ""), (5, 2, "")],
                                 "id int, cluster_id int, t string")
    profile = T.Profile(T.COHERENCE.token_pattern, 1, 1.0, 100)
    weights = T.tfidf(docs, "id", "t", profile, ["cluster_id"])
    out = {r[0]: r[1] for r in T.coherence(weights, docs).collect()}
    assert out[0] == 0.0 and out[1] == pytest.approx(1.0) and out[2] == 0.0


# ---------------------------------------------------------------- scores

def test_normalize(spark):
    df = spark.createDataFrame([(1.0, None, 5), (3.0, 2.0, 5), (None, 4.0, 5)], "a double, b double, c int")
    for small in (False, True):
        out = scoring.min_max_normalize(df, {"x": (F.col("a"), True), "y": (F.col("b"), False), "z": (F.col("c"), True)}, small)
        assert sorted(tuple(r) for r in out.select("x", "y", "z").collect()) == [(0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (1.0, 1.0, 0.5)]


def test_labels(one):
    level = scoring.confidence_level(F.col("g"), F.col("d"), F.col("c"))
    for row, expected in (((15, 8, .25), "High"), ((14, 8, .25), "Medium"), ((7, 4, .15), "Medium"), ((6, 4, .15), "Low")):
        assert one("g int, d int, c double", row, level) == expected
    kind = scoring.segment_type(F.lit(0.5), F.lit(0.1), F.lit(30), F.lit(1.0))
    assert one("a int", (1,), kind) == "Franchise cluster"
    assert one("a int", (1,), scoring.warning_text(F.lit(0.5), F.lit(0.1), F.lit(4))) == (
        "High developer/franchise concentration; Low semantic coherence; Very small cluster")
    schema = ", ".join(f"{c} double" for c in scoring.SCORE_COLUMNS)
    assert one(schema, (0.0,) * 6, scoring.signal_summary()) == "Mixed market signals; further validation recommended."
    assert one(schema, (17.0, 14.0, 0.0, 0.0, 0.0, 0.0), scoring.signal_summary()) == (
        "Strong current chart visibility; strong player validation.")


def test_concentration_of_unknown_and_ties(spark):
    games = spark.createDataFrame(
        [(1, None), (1, None), (1, "a"), (2, "b"), (2, "a")], "cluster_id int, developer string").withColumns(
        {"average_rating": F.lit(1), "chart_position": F.lit(1), "rating_count": F.lit(1), "chart_type": F.lit("x")})
    out = {r[0]: (r[1], round(r[2], 3)) for r in scoring.developer_concentration(games).collect()}
    assert out == {1: ("Unknown", 0.667), 2: ("a", 0.5)}
    assert {r["cluster_id"]: r["developer_count"] for r in scoring.segment_statistics(games).collect()} == {1: 1, 2: 2}


def test_median_against_values(spark):
    import random
    import statistics
    random.seed(5)
    data = [(k, random.choice([random.uniform(-5, 5), random.randint(-9, 10 ** 6), 0.0])) for k in (1, 2, 3) for _ in range(101 + k)]
    data += [(4, 2.0), (4, 5.0), (5, 7.0)]
    df = spark.createDataFrame([(k, float(v)) for k, v in data], "k int, v double")
    out = {r[0]: r[1] for r in scoring.grouped_median(df, "k", "v", "m").collect()}
    for k in (1, 2, 3, 4, 5):
        assert out[k] == pytest.approx(statistics.median(v for j, v in data if j == k), abs=1e-12)


# ---------------------------------------------------------------- names

def name(one, keywords, games="", developer="", cluster_id=4):
    return one("k string, g string, d string, i int", (keywords, games, developer, cluster_id),
               naming.base_name(F.col("k"), F.col("g"), F.col("d"), F.col("i")))


@pytest.mark.parametrize("keywords, games, developer, expected", [
    ("cards", "", "", "Cards Games"),
    ("merge | home", "", "", "Merge & Decoration Games"),
    ("slots | merge | home", "", "", "Casino & Real-Money Games"),
    ("puzzle", "Freddy 2", "", "Five Nights at Freddy's Franchise"),
    ("puzzle", "", "Flipline Studios", "Papa's Cooking & Time Management"),
    ("word games", "Crossword/Clue", "", "Word Games"),
    ("race | zombie", "", "", "Survival & Racing Games"),
    ("race | car | zombie", "", "", "Racing & Survival Games"),
    ("world | puzzle | puzzle mode | jigsaw", "", "", "Puzzle & Jigsaw Games"),
    ("world | 123", "", "", "Game Segment 4"),
    (None, None, None, "Game Segment 4"),
])
def test_base_names(one, keywords, games, developer, expected):
    assert name(one, keywords, games, developer) == expected


def test_unique_names(spark):
    df = spark.createDataFrame(
        [(3, "X", "tiny | pet"), (1, "X", "tiny"), (2, "X", "game | tiny"), (5, "X", "game"), (4, "Y", "")],
        "cluster_id int, cluster_name string, keywords string")
    out = {r["cluster_id"]: r["cluster_name"] for r in naming.unique_names(df, check=True).collect()}
    assert out == {1: "X", 2: "Tiny · X", 3: "Pet · X", 4: "Y", 5: "X (Segment 5)"}


# ---------------------------------------------------------------- evidence

@pytest.mark.parametrize("text, expected", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure! {"a": {"b": 2}} done', '{"a": {"b": 2}}'),
    ("no json", None), ("", None), ("} {", None), ("[1]", "[1]"), ('```\n{"a": 1}', '{"a": 1}'),
])
def test_extract_object(one, text, expected):
    assert one("a string", (text,), evidence.extract_object(F.col("a"))) == expected


@pytest.mark.parametrize("reply, status", [
    ({"response": '{"title": "T"}'}, "ok"), ({"response": 5}, "empty"), ({"response": "oops"}, "invalid_json"),
    ({"response": "[1]"}, "not_an_object"), ({"result": {"output_text": "{}"}}, "ok"), ("{}", "ok"), (None, "failed"),
])
def test_reply_status(spark, reply, status):
    text = None if reply is None else json.dumps(reply)
    df = evidence.classify_replies(spark.createDataFrame([(text,)], "reply string"))
    assert df.first()["status"] == status


def test_title_history_keeps_first_uses(spark):
    titles = spark.createDataFrame([("s", t, i) for i, t in enumerate(["a", "b", "a", " ", "c", "d", "e", "f"])],
                                   "segment string, title string, generated_at int")
    assert evidence.title_history(titles).first()["previous_titles"] == ["b", "c", "d", "e", "f"]


def test_prompt_defaults(spark):
    payload = json.dumps({"cluster_name": "N", "keywords": ["k"], "representative_games": []})
    prompt = evidence.render_prompts(spark.createDataFrame([(payload,)], "payload string")).first()["prompt"]
    assert "Market signal: Not available" in prompt and "Titles used before, to be avoided: None" in prompt
    assert "No reliable review pain points available." in prompt and evidence.STYLES["differentiated"] in prompt


def test_stage_facts_need_a_table():
    with pytest.raises(ValueError):
        market.stage_facts()


# ---------------------------------------------------------------- snapshots, guards, collection

def test_half_written_snapshots_are_never_read(spark, tmp_path):
    from segmentry.sources import snapshots

    path, rows = str(tmp_path / "store"), lambda n: spark.range(n).withColumnRenamed("id", "app_id")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path)
    assert snapshots.commit_snapshot(rows(3), path, "20240101_000000") == 3
    snapshots.write_attempt(rows(9), path, "20240102_000000")
    snapshots.write_attempt(rows(9), path, "20240101_000000")
    assert snapshots.read_snapshot(spark, path).count() == 3 and snapshots.all_snapshots(spark, path).count() == 3
    snapshots.commit_snapshot(rows(5), path, "20240101_000000")
    snapshots.commit_snapshot(rows(0), path, "20240102_000000")
    assert snapshots.read_snapshot(spark, path).count() == 0
    assert snapshots.read_snapshot(spark, path, "20240101_000000").count() == 5
    assert {(r["snapshot_ts"], r["rows"]) for r in snapshots.manifest(spark, path).collect()} == {("20240101_000000", 5), ("20240102_000000", 0)}
    plan = snapshots.read_snapshot(spark, path, "20240101_000000").inputFiles()
    assert plan and all("snapshot_ts=20240101_000000" in f for f in plan) and len({f.split("attempt=")[1].split("/")[0] for f in plan}) == 1


def test_guards_count_what_is_written(spark, tmp_path):
    from segmentry.contracts import CHECKED, stored_checked

    out = stored_checked(spark.range(10), str(tmp_path / "a"), {"rows": CHECKED, "large ones": (F.col("id") > 5, 4)})
    assert out.count() == 10
    with pytest.raises(ValueError, match="too few usable large ones: 4, need 5"):
        stored_checked(spark.range(10), str(tmp_path / "b"), {"large ones": (F.col("id") > 5, 5)})
    with pytest.raises(ValueError, match="too few usable rows: 0, need 1"):
        stored_checked(spark.range(0), str(tmp_path / "c"), {"rows": CHECKED})


def test_collection_runs_again_only_where_input_changed(spark, folder, tmp_path):
    from segmentry.plans import collection
    from segmentry.workload import views as V

    paths = {n: str(tmp_path / n) for n in ("chart_docs", "lookup_docs", "review_pages")}
    V.chart_feed_docs(spark, folder).limit(200).write.parquet(paths["chart_docs"])
    V.lookup_docs(spark, folder).write.parquet(paths["lookup_docs"])
    V.review_pages(spark, folder).write.parquet(paths["review_pages"])
    run = lambda **more: collection.run_collection(spark, str(tmp_path / "root"), **paths, **more)
    first = run()
    assert first.ran == ("collect", "enrich", "reviews") and run().ran == ()
    assert run(max_reviews=2).ran == ("reviews",) and run().ran == ()
    V.lookup_docs(spark, folder).limit(1).write.mode("append").parquet(paths["lookup_docs"])
    again = run()
    assert again.ran == ("enrich", "reviews") and again.enriched.count() == first.enriched.count()
    spark.createDataFrame([('{"feed":{"entry":"x"}}', "top_paid", "u", "2024-01-01")], "doc string, chart_type string, source_url string, snapshot_date string"
                          ).write.mode("overwrite").parquet(paths["chart_docs"])
    with pytest.raises(ValueError, match="too few usable chart rows"):
        run()


def test_reviews_landed_twice_load_once(spark, folder, tmp_path):
    from segmentry.streaming import ingest
    from segmentry.workload import views as V

    landed, out, state, into = (str(tmp_path / n) for n in ("landed", "out", "state", "into"))
    V.review_pages(spark, folder).repartition(3).write.parquet(landed)
    ingest.load_reviews(spark, landed, out, state, files_per_step=1, unique=True)
    first = ingest.compacted(spark, out).count()
    V.review_pages(spark, folder).write.mode("append").parquet(landed)
    ingest.load_reviews(spark, landed, out, state, unique=True)
    assert first > 0 and ingest.compacted(spark, out).count() == first and ingest.compact(spark, out, into).count() == first


def test_texts_are_counted_in_bounded_slices():
    """Copies made while counting follow SLICE_BYTES, not the whole batch; a longer row stands alone."""
    import pyarrow as pa

    lists = [["word"] * n for n in (10, 900_000, 0, 5, 70_000, 70_000, 70_000, 70_000, 70_000, 70_000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["id", "words"])
    cut = list(T.slices([batch, batch.slice(0, 0)]))
    assert len(cut) > 4 and all(b.num_rows < 2 or b.nbytes <= T.SLICE_BYTES for b in cut)
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))


def test_bundle_reads_its_charts_once(spark, tmp_path, monkeypatch):
    from segmentry.workload import collection

    seen = spark.sparkContext.accumulator(0)

    def marked(value):
        seen.add(1)
        return value

    rows = [(str(i % 4), f"t{i}", "d", "top_free", i % 5, i % 3, 4.0, 1.0) for i in range(20)]
    charts = spark.createDataFrame(rows, "app_id string, title string, developer string, chart_type string, chart_position int,"
                                   "cluster_id int, average_rating double, rating_count double")
    monkeypatch.setattr(collection.V, "charts", lambda *_: charts.withColumn("title", F.udf(marked)("title")))
    found = {r["table"]: r["rows"] for r in collection.bundle_load(spark, "none").collect()}
    assert set(found.values()) == {16, 12, 8}
    assert seen.value == 20


def test_snapshot_apps_are_counted_by_partition(spark, monkeypatch):
    from segmentry.workload import collection

    rows = [("1", "t", "d", "top_free", 1), ("1", "t", None, "top_free", 1), (None, "t", "d", "top_free", 1), ("2", "t", "d", "top_paid", None)]
    charts = spark.createDataFrame(rows, "app_id string, title string, developer string, chart_type string, chart_position int")
    monkeypatch.setattr(collection.V, "charts", lambda *_: charts)
    out = collection.snapshot_append(spark, "none")
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r) for r in out.select("snapshot_ts", "chart_type", "chart_position", "rows", "apps", "developers", "is_newest").collect()}
    assert found == {("20240101_000000", "top_free", 1, 3, 1, 2, False), ("20240101_000000", "top_paid", None, 1, 1, 1, False),
                     ("20240102_000000", "top_free", 2, 3, 1, 2, True), ("20240102_000000", "top_paid", None, 1, 1, 1, True)}


def test_landed_feeds_lie_in_even_files(spark, tmp_path, monkeypatch):
    from segmentry.workload import collection

    docs = spark.range(50, numPartitions=1).select(F.col("id").cast("string").alias("doc"))
    for view in ("chart_feed_docs", "lookup_docs", "review_pages"):
        monkeypatch.setattr(collection.V, view, lambda *_: docs)
    monkeypatch.setattr(collection, "LANDED_ROWS", 20)
    for path in collection._landed(spark, "none").values():
        landed = spark.read.parquet(path)
        assert landed.count() == 50 and len(landed.inputFiles()) == 3


@pytest.mark.parametrize("space", ["", " \n"])
def test_lone_entries_are_told_by_how_a_document_begins(spark, space):
    from segmentry.sources import feeds

    bodies = ['{"id":{"label":"a"}}', '[{"id":{"label":"a"}}]', '[{"id":{"label":"a"}},3,{"id":{"label":"b"}}]', '"none"', "3", "{", "null", "{}"]
    docs = [space + '{"feed"' + space + ":" + space + '{"entry":' + space + b + "}}" for b in bodies]
    docs += ['{"feed":{"title":"t","entry":{"id":{"label":"a"}}}}', '{"feed":{}}', "", "[]", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    kind = "struct<id:struct<label:string>>"
    got = {r["i"]: r["ids"] for r in rows.select("i", F.transform(feeds._entries(F.col("doc"), kind), lambda e: e["id"]["label"]).alias("ids")).collect()}
    assert [got[i] for i in range(3)] == [["a"], ["a"], ["a", "b"]] and got[8] == ["a"]
    assert all(not got[i] for i in (3, 4, 5, 9, 10, 11, 12))
    feed = {r["i"]: r["f"] for r in rows.select("i", feeds.is_chart_feed(F.col("doc")).alias("f")).collect()}
    assert [i for i, f in feed.items() if not f] == [3, 4]
