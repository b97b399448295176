"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from segmentry.llm.common import CHUNK_BYTES, bound_batches, table

#: Words a worker remembers, and the longest word it remembers.
MEMORY_WORDS, MEMORY_LENGTH = 100_000, 40

# Where the tokenizers library's Unicode tables differ from those of Python 3.13 and of regex, as found
# by trying all code points (a test tries the affected regions again). Ranges are hexadecimal, ends included.
#: Letters and numbers of later versions: the library's splitting takes them for other signs.
LATER_LETTERS = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD"""
#: Combining marks of later versions: the library's normalisation does not move them.
LATER_MARKS = """7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50
10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1
1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
#: Capital letters of later versions (range, first small letter): the library lower-cases them.
LATER_CAPITALS = (("1C89", "1C8A"), ("A7CB", "264"), ("A7CC", "A7CD"), ("A7CE", "A7CF"), ("A7D2", "A7D3"), ("A7D4", "A7D5"),
                  ("A7DA", "A7DB"), ("A7DC", "19B"), ("10D50-10D65", "10D70"), ("16EA0-16EB8", "16EBB"))


def _class(ranges: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    return "".join("-".join(f"\\U{int(end, 16):08X}" for end in part.split("-")) for part in ranges.split())


_LATER_LETTERS, _LATER_MARKS = regex.compile(f"[{_class(LATER_LETTERS)}]"), regex.compile(f"([{_class(LATER_MARKS)}])")
#: No code point before it is in one of these tables.
_FIRST_LATER = chr(min(int(r.split("-")[0], 16) for r in f"{LATER_LETTERS} {LATER_MARKS}".split()))
_SMALL = {int(r.split("-")[0], 16) + i: int(small, 16) + i for r, small in LATER_CAPITALS
          for i in range(int(r.split("-")[-1], 16) - int(r.split("-")[0], 16) + 1)}
_LATER_CAPITALS = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


def normalized(text: str) -> str:
    """NFC and lower case as the library has them: characters are lower-cased one by one, so there is no final sigma."""
    if text.isascii():
        return text.lower()
    if max(text) < _FIRST_LATER:  # one cheap look instead of three searches
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    if _LATER_MARKS.search(text):
        text = "".join(unicodedata.normalize("NFC", part) for part in _LATER_MARKS.split(text))
    else:
        text = unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ").lower()
    return text.translate(_SMALL) if _LATER_CAPITALS.search(text) else text


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class Vocabulary:
    """A word-level BPE vocabulary file: symbols, merges sorted by pair, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (ids | self.special).items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        characters = _byte_characters()
        self.inner = np.array([ids[c] for c in characters])
        self.last = np.array([ids[c + suffix] for c in characters])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs])
        merged = np.array([ids[a + b] for a, b in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order, merged[order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern, later = split["pattern"]["Regex"], _class(LATER_LETTERS)
        self.words = regex.compile(pattern)
        # the same with later letters among the other signs
        self.later_words = regex.compile("(?V1)" + pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{later}]]").replace(
            r"[\p{N}]", rf"[\p{{N}}--[{later}]]").replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """Normalised words; a special token stays one item, prefixed by NUL."""
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            return [w for i, part in enumerate(parts)
                    for w in (["\0" + part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = normalized(text)
        plain = text.isascii() or max(text) < _FIRST_LATER or not _LATER_LETTERS.search(text)
        words = self.words if plain else self.later_words
        return words.findall(text)

    def merge(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many words: every round merges each word's lowest-ranked pair."""
        raw = [w.encode() for w in items]
        sizes = np.array([len(w) for w in raw], np.int64)
        symbols = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[np.frombuffer(b"".join(w[-1:] for w in raw), np.uint8)]
        owner = np.repeat(np.arange(len(items)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            pair, rank = self._ranks(symbols, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(best, np.diff(np.r_[starts, len(symbols)]))
            open_ = lowest < len(self.keys)
            done.append((owner[~open_], symbols[~open_]))
            symbols, owner, pair, rank, lowest = (x[open_] for x in (symbols, owner, pair, rank, lowest))
            hit = rank == lowest
            # in a run such as a a a every second pair merges, from the left
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) > 1]) if len(at) else at
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(at) else at
            odd = (np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % 2 == 1
            at = at[~odd]
            symbols[at] = self.merged[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        symbols = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(items)))]

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted pairs and rank of the pair that begins at each symbol."""
        none = len(self.keys)
        rank = np.full(len(symbols), none)
        place = np.zeros(len(symbols), np.int64)
        key = symbols[:-1] << 32 | symbols[1:]
        place[:-1] = np.minimum(np.searchsorted(self.keys, key), none - 1)
        known = (self.keys[place[:-1]] == key) & (owner[1:] == owner[:-1])
        rank[:-1][known] = self.ranks[place[:-1][known]]
        return place, rank


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Encoder:
    """Encodes lists of texts; frequent words are merged once and remembered up to a bound."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self._clear()

    def _clear(self) -> None:
        self._place = {"\0" + t: k for k, t in enumerate(self.vocabulary.special)}
        self._flat = np.array(list(self.vocabulary.special.values()), np.int32)
        self._offsets = np.arange(len(self._flat) + 1)

    def __call__(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) over all texts."""
        if len(self._place) > MEMORY_WORDS:
            self._clear()
        split = [self.vocabulary.split(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self._place})
        place, flat, offsets = self._place, self._flat, self._offsets
        if new:
            new.sort(key=len)  # remembered words come first
            ids, ends = self.vocabulary.merge(new)
            have = len(offsets) - 1
            place = place | {w: have + i for i, w in enumerate(new)}
            kept = sum(len(w) <= MEMORY_LENGTH for w in new)
            flat, offsets = np.r_[flat, ids], np.r_[offsets, offsets[-1] + ends[1:]]
            self._place = {w: p for w, p in place.items() if p < have + kept} if kept < len(new) else place
            self._flat, self._offsets = flat[:offsets[have + kept]], offsets[:have + kept + 1]
        at = np.fromiter((place[w] for ws in split for w in ws), np.int64, sum(map(len, split)))
        sizes = offsets[at + 1] - offsets[at]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[at] - (ends - sizes), sizes)]
        words = np.r_[0, np.cumsum([len(ws) for ws in split])].astype(np.int64)
        return ids, np.r_[0, ends][words]


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of about CHUNK_BYTES of text."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
    block = np.cumsum(sizes) // CHUNK_BYTES if len(sizes) else sizes
    edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(column)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield column.slice(a, b - a)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the token ids of the whole text; null and empty texts have none.

    As the library encodes with add_special_tokens=False: a special token's string in the text is that
    token. All other columns pass through; a column named `ids` is replaced. No shuffle.
    """
    bound_batches(df.sparkSession)
    df = df.drop(ids)
    # the text goes last so that other columns pass through untouched
    schema = StructType([*df.schema.fields, StructField(ids, ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            done = 0
            for part in _slices(batch.column(text)):
                flat, offsets = encoder(part.to_pylist())
                rows = batch.slice(done, len(part))
                done += len(part)
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with its ids decoded: the tokens' strings joined by a space, as the file names no decoder.

    Special tokens are kept; null or empty ids give an empty text. No shuffle.
    """
    bound_batches(df.sparkSession)
    df = df.drop(text)
    schema = StructType([*df.schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary(path).names
        for batch in batches:
            column = batch.column(ids)
            tokens = names[np.asarray(column.flatten())]
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))
            texts = [" ".join(tokens[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def default_vocabulary() -> str:
    """Path of the public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """Every document encoded, then decoded from its ids."""
    path = path or default_vocabulary()
    encoded = encode(table(spark, folder, "documents").select("doc_id", "text"), path).drop("text")
    return decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
