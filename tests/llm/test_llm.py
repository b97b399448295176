"""The training-data operators against plain versions, on small tables with every awkward row."""

from __future__ import annotations

import collections
import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import oracle
import pytest
from pyspark.sql import functions as F

from segmentry.llm import (bpe, chat, common, decontaminate, jaccard, language, pages, quality, registry, repeats, secrets,
                           vectors)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RND = random.Random(7)
WORDS = ["".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RND.randint(2, 8))) for _ in range(900)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def changed(text, every, rnd=RND):
    words = text.split(" ")
    for i in range(rnd.randrange(every), len(words), every):
        words[i] = rnd.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    long = prose(3_000)
    base, passage = prose(200), prose(90)
    out = [None, "", "  \n", "one", "two words", "Two WORDS", base, base, base.upper(), changed(base, 60), changed(base, 45),
           changed(base, 12), passage + " " + prose(40), prose(50) + " " + passage, long, long + " " + prose(5), "ab " * 700,
           "é" * 900, passage]
    out += [changed(base, 70) for _ in range(40)] + [passage + " " + prose(12) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- shared helpers ---

def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2), (2, 3)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- op1 ---

def repeats_plainly(texts, first):
    data = [(t or "").encode() for t in texts]
    grams = [[d[i:i + repeats.LENGTH] for i in range(len(d) - repeats.LENGTH + 1)] for d in data]
    count, seen, out = collections.Counter(g for gs in grams for g in gs), set(), []
    for d, gs in zip(data, grams):
        gone = bytearray(len(d))
        for i, g in enumerate(gs):
            if g in seen if first else count[g] > 1:
                gone[i:i + repeats.LENGTH] = b"\1" * repeats.LENGTH
            seen.add(g)
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, x in zip(d, gone) if not x)))
    return out


@pytest.mark.parametrize("first,group", [(False, 2_000), (False, 4), (True, 4)])
def test_repeats(docs, texts, first, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    got = {r[0]: tuple(r[1:4]) + (bytes(r[4]),) for r in repeats.remove_repeats(docs.coalesce(1), keep_first=first).collect()}
    assert got == dict(enumerate(repeats_plainly(texts, first)))


def test_repeats_of_long_rows_and_empty_table(spark, nothing, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(common, "CHUNK_BYTES", 3_000)
    text = prose(2_500)
    given = [text, text[5_000:9_000] + "x", "ab" * 5_000]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), keep_first=False)
    assert [tuple(r[1:4]) for r in sorted(got.collect())] == [w[:3] for w in repeats_plainly(given, False)]
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_when_executors_come_and_go(spark, tmp_path, monkeypatch):
    passage = prose(90)
    rows = [(i, (prose(30) + " " + passage if i % 3 else prose(60)) + f" {i}") for i in range(80)] + [(5, passage), (5, passage), (None, passage)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(40).write.parquet(str(tmp_path / "docs"))
    stored, steps = repeats.materialize, []

    def shifting(df, name):
        out = stored(df, name)
        steps.append(name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + 5 * (len(steps) % 3)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m" if len(steps) % 2 else "128m")
        return out

    monkeypatch.setattr(repeats, "materialize", shifting)
    try:
        for first in (False, True):
            got = repeats.remove_repeats(spark.read.parquet(str(tmp_path / "docs")), keep_first=first).collect()
            order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
            want = repeats_plainly([t for _, t in order], first)
            if first:  # which of the rows with id 5 comes first is a matter of equal rows
                assert collections.Counter((r[0], *r[1:4]) for r in got) == collections.Counter((o[0], *w[:3]) for o, w in zip(order, want))
            else:
                assert collections.Counter((r[0], *r[1:4], bytes(r[4])) for r in got) == collections.Counter((o[0], *w) for o, w in zip(order, want))
    finally:
        for key in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(key)


def test_previous_and_next_smaller():
    values = np.array([RND.randrange(50) for _ in range(200)])
    before, after = repeats.previous_and_next_smaller(values)
    for i, v in enumerate(values):
        # equal values need no care: positions are distinct
        assert before[i] == max((j for j in range(i) if values[j] <= v), default=-1) or values[before[i]] < v
    distinct = np.array(RND.sample(range(1_000), 300))
    before, after = repeats.previous_and_next_smaller(distinct)
    assert list(before) == [max((j for j in range(i) if distinct[j] < distinct[i]), default=-1) for i in range(300)]
    assert list(after) == [min((j for j in range(i + 1, 300) if distinct[j] < distinct[i]), default=300) for i in range(300)]


# --- op2 ---

def test_vectors_against_all_pairs(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for group in range(12):
        centre = rnd.standard_normal(16)
        for _ in range(25 if group else 700):  # one dense group, more than two blocks
            rows.append(((centre + rnd.standard_normal(16) * 0.11 * np.linalg.norm(centre) / 4).tolist(), group % 3))
    rows += [(rows[0][0], 0), ([2 * x for x in rows[5][0]], 0), (None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0),
             ([1.0, None], 0), (rows[0][0], None), ([], 1), ([float("inf")] * 16, 1), (rows[0][0][:4], 0)]
    table = [(i, v, k, "x") for i, (v, k) in enumerate(rows)]
    got = {r[0]: tuple(r[1:]) for r in vectors.near_duplicates(spark.createDataFrame(
        table, "vec_id long, embedding array<double>, label int, node string")).collect()}
    good = [i for i, (v, k) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = collections.defaultdict(set)
    for k in (0, 1, 2):
        for size in (4, 16):
            at = [i for i in good if rows[i][1] == k and len(rows[i][0]) == size]
            if at:
                unit = np.array([rows[i][0] for i in at])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for x, y in zip(*np.nonzero(unit @ unit.T >= vectors.COSINE)):
                    if x != y:
                        linked[at[x]].add(at[y])
    reach = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([reach[i], *(reach[j] for j in linked[i])]) for i in range(len(rows))]
        if new == reach:
            break
        reach = new
    assert got == {i: (len(linked[i]), reach[i], reach[i] == i) for i in range(len(rows))}
    assert sum(map(len, linked.values())) > 10_000


# --- op3 ---

def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "</s>[INST] \\ <\\s> [\\\\/INST]"), (1, 1, "user", "a"), (1, 2, "assistant", "<s>x</s>"),
            (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "rest[INST]"), (2, 1, None, "alone"),
            (3, 0, "assistant", "é😀"), (3, 0, "assistant", "é😀"), (None, 0, "assistant", "no id"), (4, None, "user<s>", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    examples = chat.expand(df)
    got = {r["conv_id"]: r for r in chat.digest(examples).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[conv]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), len(said), digest(said))
    masks = [r for r in examples.collect() if r["conv_id"] == 1]
    assert [(r["target_turn"], r["n_turns"]) for r in masks] == [(2, 3), (4, 5), (None, 6)]
    assert [chat_slice(r) for r in masks] == ["<\\s>x<\\/s>", "", ""]
    assert chat.expand(df.limit(0)).count() == 0


def chat_slice(row):
    return row["formatted"][row["loss_start"]:row["loss_end"]]


# --- op4 ---

def test_quality_separates_held_out_documents(spark, nothing):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.6
        text = prose(30, rnd) if good else " ".join(w + "%%%" for w in prose(30, rnd).split())
        rows.append((i, text, "en", "clean" if good == (rnd.random() < 0.9) else "junk", len(text)))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(900, None, None, None, None), (None, "x", "en", "clean", 1), (0, *rows[0][1:])]
    want = {r[0]: "%%%" not in (r[1] or "") for r in rows[:600]}
    given = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit(9)).withColumn("words", F.lit("x"))
    label = spark.createDataFrame([*labels, (1, None), (3, 5)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    got = quality.score(given, label).collect()
    assert len(got) == len(rows)
    free = [r for r in got if r["doc_id"] in want and r["doc_id"] % 2 == 0]
    assert sum(r["kept"] == want[r["doc_id"]] for r in free) >= 0.95 * len(free)
    assert all(0 <= r[c] <= 1 for r in got for c in ("p_text", "p_meta", "score"))
    assert {r["score"] for r in quality.score(given, label.limit(0)).collect()} == {0.5}
    assert quality.score(nothing, label).count() == 0


def test_all_unlabelled_documents_may_lend_labels(spark, monkeypatch):
    rnd, sizes, fit = random.Random(5), [], quality._fitted

    def counted(rows, view):
        sizes.append(rows.count())
        return fit(rows, view)

    monkeypatch.setattr(quality, "POOL", 20, raising=False)
    monkeypatch.setattr(quality, "_fitted", counted)
    rows = [(i, prose(30, rnd) if i % 3 else " ".join(w + "%%%" for w in prose(30, rnd).split()), "en", "clean" if i % 3 else "junk", 200)
            for i in range(400)]
    label = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    assert quality.score(spark.createDataFrame(rows, DOCS), label).count() == 400
    assert min(sizes[2:]) - sizes[0] >= 150  # of 200 unlabelled ones


# --- op5 ---

def test_language_fuses_evidence(spark, folder, nothing):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(-1, None, "en", "a"), (-2, "123 456", "en", None), (-3, "", None, "a"), (-4, "the", None, None)],
                                 docs.schema)
    got = {r["doc_id"]: r for r in language.identify(docs.unionByName(more).withColumn("row", F.lit(0))).collect()}
    true = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    assert sum(got[i]["language"] == k for i, k in true.items()) >= 0.98 * len(true)
    assert all(got[i]["kept"] for i, k in true.items() if got[i]["language"] == k)
    assert [(got[i]["language"], got[i]["confidence"], got[i]["kept"]) for i in (-1, -2, -3)] == [(None, 0.0, False)] * 3
    kept = language.keep_identified(docs.unionByName(more))
    assert {r[0] for r in kept.select("doc_id").collect()} >= set(true) - {i for i in true if not got[i]["kept"]}
    assert kept.filter("doc_id in (-1, -2, -3)").isEmpty() and kept.columns == docs.columns
    # wrong declarations do not beat the text, and a host tips what the text leaves open
    wrong = docs.withColumn("lang", F.when(F.pmod("doc_id", F.lit(10)) == 0, "en").otherwise(F.col("lang")))
    again = {r["doc_id"]: r["language"] for r in language.identify(wrong).collect()}
    assert sum(again[i] == k for i, k in true.items()) >= 0.97 * len(true)
    assert language.identify(nothing).count() == 0
    assert not language.identify(docs, declared=None).first()["kept"]


def test_pipeline_and_query_use_the_same_evidence(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    monkeypatch.setattr(language, "identify", lambda docs, **evidence: seen.append(evidence) or docs.withColumn("kept", F.lit(True)))
    given = spark.createDataFrame([(1, "a", "de", "site.de", 1), (2, "b", "en", "src0", 1), (3, "c", "en", None, 1)], DOCS)
    monkeypatch.setattr(language, "table", lambda *_: given)
    language.op5_language_id(spark, "")
    assert corpus_pipeline.identify_language(spark, given, "").count() == 3
    ends = [[r[0] for r in given.orderBy("doc_id").select(e["suffix"]).collect()] for e in seen]
    assert ends == [["de", None, None]] * 2


def test_page_evidence(spark):
    rows = [(1, "https://a.example.fr/x", '<html lang="FR-ca"><body>le<script>x</script> la'), (2, "http://b.org/de/1", "<p>x"), (3, None, None)]
    got = language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["declared"], r["suffix"], r["host"]) for r in got] == [("FR", "fr", "a.example.fr"), (None, "de", "b.org"), (None, None, None)]
    assert "x" not in got[0]["text"]


def test_every_declared_language_is_known(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(70):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", 9)
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7))) for _ in range(60)]
        rows += [(k * 100 + i, " ".join(rnd.choice(words) for _ in range(60)), f"l{k}", None) for i in range(12 if k < 50 else 3)]
    rows += [(50_000, rows[0][1], "only", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["language"] == lang and got[i]["kept"] for i, _, lang, _ in rows[:-1])
    assert got[50_000]["language"] == "l0"


# --- op6 ---

def sets_plainly(texts, words, split):
    out = []
    for t in texts:
        w = split(t or "")
        out.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))


@pytest.mark.parametrize("words,percent,paired", [(4, 85, 16), (4, 85, 2), (5, 80, 16)])
def test_jaccard_against_all_pairs(docs, texts, words, percent, paired, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "KEY_BLOCK", 16)
    monkeypatch.setattr(jaccard, "TEXT_BLOCK", 8)
    sets = sets_plainly(texts, words, plain_words)
    reach = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    reach[i] = min(reach[i], reach[j])
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(docs.withColumn("node", F.lit("x")), words, percent).collect()}
    assert got == {i: (len(s), reach[i]) for i, s in enumerate(sets)}
    kept = jaccard.keep_first(docs, words, percent)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(reach))


def test_part_keys_never_lose_a_link():
    rnd = np.random.default_rng(5)
    for size in (7, 12, 30, 80, 300, 1200):
        for _ in range(60):
            a = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64))
            b = a.copy()
            while True:  # as far apart as a link may be
                c = np.unique(np.r_[b[1:], rnd.integers(0, 2**63, 1, dtype=np.uint64)]) if rnd.random() < .5 else b[rnd.permutation(len(b))[1:]]
                c = np.sort(c)
                both = len(np.intersect1d(a, c))
                if 100 * both < 85 * (len(a) + len(c) - both):
                    break
                b = c
            keys, nodes = jaccard.part_keys([a, b], np.array([1, 2]), 85)
            if not np.array_equal(a, b):
                shared = np.intersect1d(keys[nodes == 1], keys[nodes == 2])
                band = int(np.searchsorted(jaccard._EDGES, max(len(a), len(b)), "right")) - 1
                assert (shared >> np.uint64(jaccard.KEY_BITS) == band).sum() >= jaccard.band_bounds(band, 85)[1]


def test_pieces_of_text_are_small_and_whole():
    texts = [bytes([97 + i % 26]) * n for i, n in enumerate([30_000] * 40 + [0, 300_000, 5])]
    got = [(first, bytes(data), np.diff(offsets).tolist()) for first, data, offsets in common.chunks(pa.array(texts, pa.binary()))]
    assert [size for _, _, sizes in got for size in sizes] == [len(t) for t in texts]
    assert b"".join(data for _, data, _ in got) == b"".join(texts)
    assert [first for first, _, _ in got] == np.cumsum([0, *(len(sizes) for _, _, sizes in got[:-1])]).tolist()
    assert all(len(data) <= 1 << 17 or len(sizes) == 1 for _, data, sizes in got)  # 64-bit values of them fit a megabyte


def test_sets_without_a_common_shingle_share_no_part_key(monkeypatch):
    monkeypatch.setattr(jaccard, "EMPTY", 1 << 30)  # parts without a shingle stay hidden: others may lack the same
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.integers(0, 2**64 - 1, size, dtype=np.uint64)) for size in rnd.integers(8, 40, 3_000)]
    keys, nodes = jaccard.part_keys(sets, np.arange(len(sets)), 80)
    met = collections.Counter(k for k, _ in set(zip(keys.tolist(), nodes.tolist())))
    assert len(met) > 20_000 and max(met.values()) == 1


def test_common_keys_left_out_lose_no_pair(spark):
    rnd = np.random.default_rng(8)
    percent, band = 85, 20
    least = jaccard.band_bounds(band, percent)[1]
    sizes = {k: int(n) for k, n in enumerate(rnd.integers(4, 12, 60))}
    owned = {node: sorted(rnd.choice(60, 2 * least, replace=False).tolist()) for node in range(12)}
    rows = [(1, (band << jaccard.KEY_BITS) + k, node, int(k % 7 == 0) + 1, sizes[k]) for node, own in owned.items() for k in own]
    met = spark.createDataFrame(rows, "kind int, a long, b long, shared long, size long")
    able = spark.createDataFrame([(node, band) for node in range(11)], "node long, band long")
    kept = {}
    for key, node in jaccard._telling_keys(met, able, percent).collect():
        kept.setdefault(node, set()).add(key - (band << jaccard.KEY_BITS))
    assert 11 not in kept and any(len(kept[node]) < len(owned[node]) for node in kept)
    for a in range(11):
        for b in range(a):
            both = set(owned[a]) & set(owned[b])
            if sum(int(k % 7 == 0) + 1 for k in both) >= least - jaccard.TOGETHER + 1:
                assert kept[a] & kept[b]


def test_sketches_compared_at_once_as_one_by_one():
    rnd = np.random.default_rng(6)
    sets = []
    for size in rnd.integers(1, 900, 40):
        whole = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64))
        sets += [whole, *(np.unique(np.r_[whole[rnd.random(len(whole)) > r], rnd.integers(0, 2**63, 1, dtype=np.uint64)]) for r in (.03, .1))]
    sizes = np.array([len(s) for s in sets])
    sketches = pa.array([b"-" * 8] + [jaccard.sketch_of(s).tobytes() for s in sets], pa.binary()).slice(1)
    a, b = np.triu_indices(len(sets), 1)
    near = []
    for x, y in zip(a, b):
        one, two = jaccard.folded([jaccard.sketch_of(sets[x]), jaccard.sketch_of(sets[y])])
        differ = int(np.bitwise_count(one ^ two).sum())
        near.append(differ * 185 <= 15 * (sizes[x] + sizes[y]) and 100 * min(sizes[x], sizes[y]) >= 85 * max(sizes[x], sizes[y]))
    words = jaccard._words(sketches)
    assert jaccard.near_mask(words, sizes, a, b, 85).tolist() == near and any(near)
    assert not len(jaccard.near_mask(words, sizes, a[:0], b[:0], 85))


def test_buckets_stay_whole_when_gathered(monkeypatch):
    monkeypatch.setattr(jaccard, "GATHERED", 3)
    buckets, pack = [0, 0, 0, 1, 2, 2], lambda x: np.array(x, np.int64).tobytes()
    keys = [[1], [2, 3], [4], [5], [6, 7], [8]]
    batches = [pa.RecordBatch.from_arrays([pa.array(buckets[i:i + 2], pa.int32()), pa.array([pack(k) for k in keys[i:i + 2]], pa.binary()),
                                           pa.array([pack(k) for k in keys[i:i + 2]], pa.binary())], names=["bucket", "keys", "nodes"])
               for i in range(0, 6, 2)]
    got = [(k.tolist(), n.tolist()) for k, n in jaccard._gathered(batches)]
    assert got == [([1, 2, 3, 4], [1, 2, 3, 4]), ([5, 6, 7, 8], [5, 6, 7, 8])]
    assert list(jaccard._gathered([batches[0].slice(0, 0)])) == []


def test_groups_stay_whole_over_batches():
    keys = [1, 1, 2, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 2], pa.int64())], names=["k"]) for i in range(0, 8, 2)]
    empty = batches[0].slice(0, 0)
    got = [t["k"].to_pylist()[s:e] for t, starts in jaccard._whole_groups([empty, *batches, empty], ["k"])
           for s, e in zip(starts, [*starts[1:], t.num_rows])]
    assert got == [[1, 1], [2], [3, 3, 3, 3], [4]]


def test_jaccard_of_nothing(nothing):
    assert jaccard.join(nothing).count() == 0


# --- op7 ---

def test_secrets(spark, nothing):
    live, copied = "Zx9Kd82hQpL0vRt5Ym3Wc7", "Qa1Ws2Ed3Rf4Tg5Yh6Uj7Ik8"
    rows = [(1, f"password = {live} and PASSWD:'abcdef' token=abc", "a"), (2, "AKIA" + "Z" * 16 + "  AKIA123 " + "0f" * 12, "a"),
            (3, None, "b"), (4, f"é😀 {live[::-1]} x", "c"), (5, "deadbeef" * 4, None)] + [(10 + i, f"see {copied}", f"o{i}") for i in range(5)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(0)).withColumn("digest", F.lit(0))
    got = [(r["doc_id"], [(s["start"], s["stop"], s["kind"], s["live"]) for s in r["spans"]]) for r in secrets.scan(df).collect()]
    by = dict(got)
    assert len(got) == len(rows) and by[3] == []
    text = rows[0][1]
    assert by[1] == [(0, 11 + len(live), 0, True), (text.index("PASSWD"), text.index("PASSWD") + 14, 0, True)]
    assert by[2] == [(0, 20, 1, True), (30, 54, 2, True)]
    assert by[4] == [(3, 25, 3, True)] and by[5] == [(0, 32, 2, True)]
    assert all(by[10 + i] == [] for i in range(5))  # copied by many owners: an example
    masked = {r[0]: r[1] for r in secrets.redact(df).select("doc_id", "text").collect()}
    assert masked[1] == "[SECRET] and [SECRET]' token=abc" and masked[4] == "é😀 [SECRET] x" and masked[10] == rows[5][1]
    assert masked[3] is None and secrets.redact(df).columns == df.columns and secrets.redact(df).count() == len(rows)
    assert secrets.scan(nothing).count() == 0


def test_secrets_of_one_owner_stay_live_at_any_number_of_copies(spark):
    mine, unknown, shared = "Zx9Kd82hQpL0vRt5Ym3Wc7", "Hb3Nf64jTsM1wXu8Pq5Ve9", "Qa1Ws2Ed3Rf4Tg5Yh6Uj7Ik8"
    rows = [(i, f"key {mine} end", "a") for i in range(6)] + [(10 + i, f"key {unknown} end", None) for i in range(6)]
    rows += [(20, f"key {shared} end", "a"), (21, f"key {shared} end", "b"), (22, f"key {shared} end", None), (30, f"key {mine} end", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: [(s["live"], s["documents"], s["owners"]) for s in r["spans"]] for r in secrets.scan(df).collect()}
    assert all(got[i] == [(True, 7, 1)] for i in (*range(6), 30)) and all(got[10 + i] == [(True, 6, 0)] for i in range(6))
    assert all(got[i] == [] for i in (20, 21, 22))
    masked = {r[0]: r[1] for r in secrets.redact(df).select("doc_id", "text").collect()}
    assert all((t == "key [SECRET] end") == (i not in (20, 21, 22)) for i, t in masked.items())


def test_secret_rules_against_a_plain_scan():
    rnd = random.Random(2)
    parts = ["password", "Secret", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef", "AKIA", "0123456789abcdef", "Z", "x" * 7, "é"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        runs, at = [], 0
        while at < len(text):  # maximal runs, one character at a time
            end = at
            while end < len(text) and text[end] in "0123456789abcdef":
                end += 1
            if end - at >= 24:
                runs.append((at, end))
            at = max(end, at + 1)
        assert [(a, b) for k, a, b, _ in secrets.candidates(text) if k == 2] == runs


# --- op8 ---

def test_main_text(spark):
    page = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style></head><body class="page-ad-free">
<header>Top</header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><div class=cookie-notice>We use</div>
<article><header><h1>Big &amp; <i>bold</i></h1></header><p>One<b>two</b> &lt;3 a &lt b<br>three<p>four
  five<aside>no</aside><div class="ad-slot">buy</div><script>var t="</p>";</script><table><tr><td>c1<td>c2</table>
<form>mail<input></form><section id=comments>reader said</section><!-- <p>gone</p> --></article><footer>&copy; end</footer>"""
    rows = [(1, "http://a.com/1", page), (2, None, None), (3, "http://a.com/2", ""), (4, "bad url", "plain & simple <3")]
    rows += [(10 + i, f"http://b.com/{i}", f"<body><div class=top>Same everywhere</div><div class=story>{prose(20)}</div>") for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("path", F.lit(1))
    got = pages.main_text(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) + 1 and got[0].asDict().keys() == {"page_id", "url", "text"}
    assert by[1] == "Big & bold Onetwo <3 a < b three four five c1 c2"
    assert (by[2], by[3], by[4]) == ("", "", "plain & simple <3")
    assert all("Same" not in by[10 + i] and len(by[10 + i].split()) == 20 for i in range(12))
    assert pages.main_text(df.limit(0)).count() == 0


def test_pages_of_the_given_table(spark, folder):
    got = {r[0]: r[1] for r in pages.op8_html_extract(spark, folder).select("page_id", "text").collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        plain = re.sub(r"</?b>", "", article)
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]+>", "\n", plain)).split())


def test_importance_outweighs_loose_marks_and_long_stories_teasers(spark):
    story = [prose(60) for _ in range(36)]
    nav = "<nav><a href=/>Home</a></nav>"
    rows = [(i, "http://a.example/" + str(i), f"<body>{nav}<div class='story widget'>{story[i]}</div><p>By author {i}</p></body>") for i in range(12)]
    rows += [(i, "http://b.example/" + str(i), f"<body>{nav}<div class='widget'>{story[i]}</div><div class='widget offer'>Buy now</div></body>")
             for i in range(12, 24)]
    rows += [(i, "http://c.example/" + str(i), f"<body>{nav}<article>Teaser {i} of another day</article><div>{story[i]}</div>"
              f"<div class='comments'>{prose(90)}</div></body>") for i in range(24, 36)]
    got = {r[0]: r[2] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{story[i]} By author {i}" for i in range(12))
    assert all(got[i] == story[i] for i in range(12, 36))


def test_main_text_weighs_marks_by_the_tree(spark):
    rows = []
    for i in range(12):
        story = prose(30)
        rows.append((i, f"http://teaser.com/{i}", f"<article>{prose(4)}</article><div class=story>{story}</div>", story))
        rows.append((20 + i, f"http://notice.com/{i}", f"<article><p>{story}</p><p>Read our terms of use</p></article>", story))
        rows.append((40 + i, f"http://form.com/{i}", f"<form><nav>Home and more</nav><div>{story}</div></form>", story))
        # every host has one page; its frame is known from the others of the domain
        rows.append((60 + i, f"http://h{i}.small.com/", f"<div class=frame>Welcome to all of us</div><div>{story}</div>", story))
    rows.append((90, "http://other.com/", "<nav>Home</nav><footer>end of 90</footer>", ""))
    got = {r[0]: r[2] for r in pages.main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith(story) for i, _, _, story in rows if i < 20)
    assert all(got[i] == story for i, _, _, story in rows if i >= 20)


# --- op9 ---

def test_tokens_equal_the_library(spark, folder, nothing):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    rnd = random.Random(4)
    pool = "aAbΣσς İıſK'sS't 've 12٣½ éÉ́ \x1c\x85​‍😀\n\t中文ﬁ<|startoftext|><|endoftext|>!!??’ßẞ\x00"
    texts = [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += [None, "", " ", "a" * 5_000, "ab" * 3_000, "<|startoftext|>hi<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (want, library.decode(want, skip_special_tokens=False))
    assert bpe.encode(nothing, path).count() == 0


# --- op10 ---

def test_containment_against_plain_sets(spark, docs, texts, nothing, monkeypatch):
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    base, passage = texts[6], texts[18]
    items = [(1, passage), (2, changed(passage, 40)), (3, " ".join(base.split()[20:27]).upper() + "!"), (4, "two words"), (5, None), (6, ""),
             (7, prose(40)), (1, passage), (8, " ".join(base.split()[:30]))]
    hold, want = sets_plainly(texts, 5, split), set()
    for i, s in zip((x[0] for x in items), sets_plainly([x[1] for x in items], 5, split)):
        want |= {(d, i, len(s & h), len(s)) for d, h in enumerate(hold) if s and 5 * len(s & h) >= 4 * len(s)}
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    for size in (decontaminate.BLOCK_BYTES, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = [tuple(r) for r in decontaminate.contained(docs.withColumn("held", F.lit(0)), table).collect()]
        assert set(got) == want and len(got) == len(want)
    kept = decontaminate.clean(docs, table)
    assert {r[0] for r in kept.select("doc_id").collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.contained(nothing, table).count() == 0
    assert decontaminate.contained(docs, table.limit(0)).count() == 0


# --- registered queries ---

@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(name, spark, folder):
    assert oracle.compare(registry.QUERIES[name](spark, folder), oracle.connect(folder), registry.SQL[name]) == ""


def test_pipeline(spark, folder):
    import corpus_pipeline

    given = common.table(spark, folder, "documents")
    whole, docs = given.count(), given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, folder), name)
        assert docs.columns == given.columns
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert 0.5 * whole < len(out) < whole and set(out) == {r[0] for r in docs.select("doc_id").collect()}
    texts = {r[0]: r[1] for r in given.select("doc_id", "text").collect()}
    sets = sets_plainly([texts[i] for i in sorted(out)], 5, plain_words)
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.values())
    items = {r[0] for r in decontaminate.op10_decontaminate(spark, folder).select("doc_id").collect()}
    assert not items & set(out)


def test_importing_without_this_package_works():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())
