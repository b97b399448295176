"""Prefix tries, personal data and periodic runs against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from segmentry.llm import identifiers, runs, trie

RND = random.Random(11)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op11 ---

def trie_plainly(conversations):
    """conversations: id -> list of (role, text), rebuilt already."""
    members = collections.defaultdict(list)
    for c in sorted(conversations):
        for d in range(len(conversations[c]) + 1):
            members[tuple(conversations[c][:d])].append(c)
    rows = []
    for p, ids in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = lambda x: [q for q in members if len(q) == len(x) + 1 and q[:len(x)] == x]
        rows.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids(p)), sum(not kids(q) for q in below),
                     sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below),
                     sha(",".join(str(c) for c in ids if len(conversations[c]) == len(p)))))
    return sorted(rows, key=repr)


def rebuilt_plainly(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            piece = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, piece, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def talk(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, ("user", "assistant")[t % 2], "same " * 3 if t < 2 and c % 3 else f"{t} é{rnd.randrange(3)}"))
    return rows


@pytest.mark.parametrize("parts,merged", [(1, 64), (8, 64), (23, 3)])
def test_trie_against_all_prefixes(spark, parts, merged, monkeypatch):
    monkeypatch.setattr(trie, "MERGED", merged)
    monkeypatch.setattr(trie, "PACKED", 4)
    rows = talk(70) + [(200, None, None, None), (200, 0, "user", "x"), (200, 0, "user", "x"), (200, 0, "assistant", ""),
                       (201, None, "user", None), (None, 0, "user", "nobody"), (203, 1, "", "user"), (204, 1, "user", "")]
    rows += [(300 + 5 * i, t, "user", f"copy {t}") for i in range(40) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).withColumn("base", F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(df)).collect()), key=repr)
        assert trie.prefix_trie(trie.rebuilt(df.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == trie_plainly(rebuilt_plainly([r[:4] for r in rows]))
    assert sum(r[2] is None for r in got) == 1


def test_trie_of_turnless_and_very_long_conversations(spark):
    # 1 borrows from a missing conversation and loses its own only turn: crc32("1") % 9 > 0
    assert zlib.crc32(b"1") % 9 > 0
    rows = [(1, 0, "user", "gone")] + [(10, t, "user", f"{t % 7}") for t in range(2_000)] + [(15, 0, "user", "a" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(trie.rebuilt(df)).collect()}
    assert len(got) == 2_002 and got[1, 0]["ends_sha256"] == sha("1") and got[1, 0]["n_leaves"] == 2
    assert got[10, 2_000]["n_children"] == 0 and got[10, 2_000]["ends_sha256"] == sha("10")


# --- op12 ---

def personal_plainly(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_identifiers_equal_a_plain_scan():
    parts = ["a", "b9", "@", "@", ".", ".", "-", "%", "+", "+1", " ", "(", ")", "1", "22", "255", "256", "0", "00001", "4111 1111 1111 1111",
             "é", "４", "1.2.3.4", "x@y.z", "012", "\n"]
    for _ in range(8_000):
        text = "".join(RND.choice(parts) for _ in range(RND.randint(0, 25)))
        assert identifiers.identifiers(text) == personal_plainly(text), text


@pytest.mark.parametrize("text,kind,found", [
    ("write john dot doe at example dot com please", "email", "john dot doe at example dot com"),
    ("(john.doe [at] example [dot] com)", "email", "john.doe [at] example [dot] com"),
    ("to j​ohn@exam​ple.com", "email", "j​ohn@exam​ple.com"),
    ("john＠exаmple.com x", "email", "john＠exаmple.com"),
    ("ring plus one two zero two five five five one two three four", "phone", "plus one two zero two five five five one two three four"),
    ("+49 (170) ５５５-１２３４", "phone", "+49 (170) ５５５-１２３４"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("é four" + " one" * 15 + ".", "card", "four" + " one" * 15),
    ("host 192[.]168[.]1[.]1,", "ip", "192[.]168[.]1[.]1"),
    ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
])
def test_disguised_identifiers_map_back_to_their_source(text, kind, found):
    assert [(identifiers.KINDS[k], text[a:b], d) for k, a, b, d in identifiers.spans(text)] == [(kind, found, True)]


@pytest.mark.parametrize("text", [
    "Meet at noon. The dot on the i at home", "look at example.com", "mail at the point of sale", "look at the dot on the i",
    "one two three four", "version 1.2.3 at two dot five", "eins zwei drei, un deux trois", "５００ at the ２ dot", "", "　"])
def test_plain_prose_has_no_identifiers(text):
    assert identifiers.spans(text) == []


def test_composed_rewrites_keep_offsets():
    of = identifiers.tape("abc def ghi")
    of = identifiers.rewrite(of, [(0, 3, "X"), (4, 5, "")])  # X ef ghi
    of = identifiers.rewrite(of, [(2, 3, "YY"), (6, 7, "Z")])
    assert of.text == "X YYf gZi"
    assert [of.source(i, i + 1) for i in range(len(of.text))] == [
        (0, 3), (3, 4), (5, 6), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11)]


def test_personal_data_of_tables(spark):
    texts = [None, "", "a@b.c and 1.2.3.4", "a@b.c and 1.2.3.4", "x" * 400_000 + " a@b.cd", "1" * 400_000, " " * 300_000, "a [at] b [dot] cd"]
    rows = [(None if i == 3 else i, t, "s", 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in identifiers.find(df).collect()}
    want = [(0, 0, 5, False), (10, 1, 17, False)]
    assert got == {0: [], 1: [], 2: want, None: want, 4: [(400_001, 0, 400_007, False)], 5: [], 6: [], 7: [(0, 0, 17, True)]}
    masked = {r["doc_id"]: r["text"] for r in identifiers.mask(df).collect()}
    assert (masked[0], masked[2], masked[7]) == (None, "[EMAIL] and [IP]", "[EMAIL]")
    assert identifiers.find(df.limit(0)).count() == 0 and identifiers.mask(df).columns == df.columns


# --- op13 ---

def runs_plainly(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_plainly(words):
    gone = {i for s, n, q in runs_plainly(words) for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_against_all_periods(monkeypatch):
    monkeypatch.setattr(runs, "LOOKED_UP", 50)
    for _ in range(25):
        texts = [[]]
        for _ in range(25):
            words = []
            for _ in range(RND.randint(0, 6)):
                unit = [RND.choice("abc") for _ in range(RND.randint(1, 7))]
                words += (unit * RND.randint(1, 9))[:RND.randint(0, 40)] + [RND.choice("abcdefgh") for _ in range(RND.randint(0, 4))]
            texts.append([w.encode() for w in words])
        got = list(runs._word_runs(texts))
        assert [g[0] for g in got] == [runs_plainly(t) for t in texts]
        assert [g[1] for g in got] == [collapsed_plainly(t) for t in texts]


def test_periodic_runs_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK_WORDS", 200)
    texts = [None, "", " \n", "a", "a a a a a a", "A a A a A a A a", "x y z " * 9 + "x y", "b " * 5, "w\x85w " * 6, "q " * 60_000]
    texts += [" ".join(RND.choice("abcdefgh") for _ in range(RND.randint(1, 90))) for _ in range(80)]
    rows = [(None if i == 6 else i * 7, t, "1", 2) for i, t in enumerate(texts)] + [(21, "again", "1", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = collections.Counter()
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (j - a) % p] if j >= a else words[j] for j in range(n)]
        found = runs_plainly(words) if n < 1_000 else [(0, n, 1)]
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        kept = collapsed_plainly(words) if n < 1_000 else words[:1]
        want[(i, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
              sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))] += 1
    assert got == want
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- op9: the library's own tables ---

def test_words_of_code_points_equal_the_library():
    from tokenizers import Tokenizer

    from segmentry.llm import bpe

    path = bpe.default_vocabulary()
    library, own, shown = Tokenizer.from_file(path), bpe.Vocabulary(path), bpe._byte_characters()
    # all regions with characters that newer versions of the tables added
    points = (*range(0x3000), *range(0xA640, 0xAC00), *range(0x10000, 0x13000), *range(0x16A00, 0x19200), *range(0x1D000, 0x1F000),
              *range(0x2B700, 0x2D000))
    wrong = []
    for c in map(chr, points):
        text = f"b{c}b 1{c}1 !{c}! a\u0345{c}b a{c}\u0334b a{c}\u0301 \u0391{c}\u03a3"
        words = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        if c not in "<|" and words != ["".join(shown[b] for b in w.encode()) for w in own.split(text)]:
            wrong.append(hex(ord(c)))
    assert wrong == []
