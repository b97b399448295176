"""TF-IDF on packed rows: every text is cleaned and tokenised once, for all profiles together.

Plan: one scan turns texts into rows of terms and counts, written without the texts. Document
frequencies of all profiles come from one map-side combined pass over these rows. The vocabularies
(at most `max_features` terms each) then turn every row into column numbers and weights. A document
stays one row throughout; only counts and sums per term travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentry.functions import constants as K
from segmentry.functions.columns import let
from segmentry.session import materialize, release


@dataclass(frozen=True)
class Profile:
    """Vectoriser settings: token pattern, document-frequency limits, vocabulary size."""

    token_pattern: str
    min_df: int
    max_df: float
    max_features: int
    stopwords: Sequence[str] = K.ENGLISH_STOPWORDS

    @property
    def tokenizer(self) -> tuple[str, tuple[str, ...]]:
        """What decides the tokens: profiles that agree on it share them."""
        return self.token_pattern, tuple(self.stopwords)


# The four profiles.
CATALOG = Profile(K.WORD_TOKEN, min_df=3, max_df=0.70, max_features=6000)
REVIEWS = Profile(K.REVIEW_TOKEN, min_df=2, max_df=0.80, max_features=5000)
COHERENCE = Profile(K.DEFAULT_TOKEN, min_df=2, max_df=0.80, max_features=5000)
EMBEDDING_KEYWORDS = Profile(K.WORD_TOKEN, min_df=2, max_df=0.75, max_features=6000)

#: Bytes of the columns that are worked on at once: copies of them, not of whole batches, take memory.
SLICE_BYTES = 2 << 20
#: Terms whose counts a task adds up before it passes them on: they bound its memory.
HELD_TERMS = 1_000_000
#: Buckets that terms are dealt to by a hash of theirs, and how many of them a vocabulary term is first looked for in.
BUCKETS = 1 << 17
BUCKETS_PER_FEATURE = 4
#: Values of the cluster centres (clusters x terms) that rows are compared with at most.
CENTRE_VALUES = 4_000_000


# --- packed rows ----------------------------------------------------------------------------

def tokens(text: Column, profile: Profile) -> Column:
    """Lower-case tokens without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                                 F.lit(profile.token_pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*profile.stopwords))


def unigrams_and_bigrams(words: Column) -> Column:
    """Words followed by pairs of neighbours."""
    return let(words, lambda w: F.concat(w, F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
        F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b))))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to SLICE_BYTES; a longer row stands alone."""
    for batch in batches:
        yield from _halved(batch)


def _halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Halves of halves, since rows differ in length."""
    if batch.num_rows < 2 or batch.nbytes <= SLICE_BYTES:
        yield batch
    else:
        middle = batch.num_rows // 2
        yield from _halved(batch.slice(0, middle))
        yield from _halved(batch.slice(middle))


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and the row of each; a null list is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), lengths)


def _lists(rows: np.ndarray, size: int, values: pa.Array) -> pa.ListArray:
    """A list column of `size` rows from values in order of their row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(size + 1)).astype(np.int32)), values)


@dataclass(frozen=True)
class Counted:
    """Terms of a few rows: cells of every row, the term of each cell (a place among the different ones) and how often it stands there."""

    lengths: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    terms: pa.Array
    buckets: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    @staticmethod
    def of(terms: pa.Array, counts: pa.Array, buckets: pa.Array | None = None) -> Counted:
        """From list columns of packed rows."""
        flat, row = _flat(terms)
        coded = pc.dictionary_encode(flat.cast(pa.large_string()))
        codes, known = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int32)
        if buckets is not None:
            known[codes] = _flat(buckets)[0].to_numpy(zero_copy_only=False)
        return Counted(np.bincount(row, minlength=len(terms)), codes, _flat(counts)[0].to_numpy(zero_copy_only=False), coded.dictionary, known)

    def boxed(self) -> list[bytes]:
        """As BOXED columns hold it."""
        offsets, data = self.terms.buffers()[1:] if len(self.terms) else (None, None)
        return [self.lengths.astype(np.int32).tobytes(), self.codes.astype(np.int32).tobytes(), self.counts.astype(np.int32).tobytes(),
                self.buckets.astype(np.int32).tobytes(), offsets.to_pybytes() if offsets else b"", data.to_pybytes() if data else b""]

    @staticmethod
    def unboxed(lengths: pa.Scalar, codes: pa.Scalar, counts: pa.Scalar, buckets: pa.Scalar, offsets: pa.Scalar | None = None,
                data: pa.Scalar | None = None) -> Counted:
        number = [np.frombuffer(x.as_buffer(), np.int32) for x in (lengths, codes, counts, buckets)]
        known = pa.array([], pa.large_string())
        if offsets is not None and len(number[3]):
            known = pa.LargeStringArray.from_buffers(len(number[3]), offsets.as_buffer(), data.as_buffer())
        return Counted(*number[:3], known, number[3])


#: Columns of one tokenizer in boxed rows, where a record holds a slice of the texts.
BOXED = ("lengths", "codes", "counts", "buckets", "offsets", "data")


def _pieces(batches: Iterator[pa.RecordBatch], different: int, keep: int = 0) -> Iterator[tuple[list[pa.Array], list[Counted]]]:
    """(kept columns, counted terms of each tokenizer) from batches of packed rows or of boxed ones, as `_read` names their columns."""
    for batch in batches:
        boxes = [i for i, name in enumerate(batch.schema.names) if name.startswith("lengths_")]
        if not boxes:
            for part in _halved(batch):
                each = (part.num_columns - keep) // different
                yield part.columns[:keep], [Counted.of(*part.columns[keep + i * each:keep + (i + 1) * each]) for i in range(different)]
            continue
        ends = [*boxes[1:], batch.num_columns]
        for row in range(batch.num_rows):
            kept = []
            if keep:
                table = pa.ipc.open_stream(batch.column(0)[row].as_buffer()).read_all()
                kept = [c.combine_chunks() for c in table.columns]
            yield kept, [Counted.unboxed(*(batch.column(c)[row] for c in range(a, b))) for a, b in zip(boxes, ends)]


def _is_boxed(rows: DataFrame) -> bool:
    return "kept" in rows.columns and "lengths_0" in rows.columns


def _read(rows: DataFrame, keep: Sequence[str], tokenizers: Sequence[int], names: bool = True, buckets: bool = True) -> DataFrame:
    """The columns that `_pieces` needs of packed or boxed rows."""
    if _is_boxed(rows):
        return rows.select(*(["kept"] if keep else []), *(f"{c}_{i}" for i in tokenizers for c in (BOXED if names else BOXED[:4])))
    return rows.select(*keep, *(f"{c}_{i}" for i in tokenizers for c in ("terms", "counts", *(["buckets"] if buckets else []))))


def _counted(words: pa.Array) -> Counted:
    """Distinct words and pairs of neighbouring words of every row, how often each stands there, and its bucket.

    Pairs are told apart by the numbers of their words; only different ones are written out.
    """
    flat, row = _flat(words)
    coded = pc.dictionary_encode(flat.cast(pa.large_string()))
    known, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    near = np.flatnonzero(row[1:] == row[:-1])
    paired = pc.dictionary_encode(pa.array(code[near] * max(len(known), 1) + code[near + 1]))
    first, second = np.divmod(paired.dictionary.to_numpy(), max(len(known), 1))
    pairs = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), pa.scalar(" ", pa.large_string()))
    # a word may hold a blank where the token pattern lets it, and then equal a pair
    coded = pc.dictionary_encode(pa.concat_arrays([known, pairs]))
    terms, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    place = np.concatenate([row, row[near]]).astype(np.int64) * max(len(terms), 1) + number[
        np.concatenate([code, paired.indices.to_numpy() + len(known)])]
    place, counts = np.unique(place, return_counts=True)
    rows, codes = np.divmod(place, max(len(terms), 1))
    bucket = (hash_array(terms.to_numpy(zero_copy_only=False), categorize=False) % BUCKETS).astype(np.int32)
    return Counted(np.bincount(rows, minlength=len(words)), codes, counts.astype(np.int32), terms, bucket)


def _listed(c: Counted) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """Terms, counts and buckets as list columns."""
    rows, size = c.rows, len(c.lengths)
    return (_lists(rows, size, c.terms.take(pa.array(c.codes)).cast(pa.string())), _lists(rows, size, pa.array(c.counts)),
            _lists(rows, size, pa.array(c.buckets[c.codes])))


#: Patterns that mean the same to Python as to Java in texts of ASCII characters.
PLAIN_PATTERNS = (K.WORD_TOKEN, K.REVIEW_TOKEN, K.DEFAULT_TOKEN)


def _words_of(texts: list[str | None], words: pa.Array, find, stopwords: frozenset[str]) -> pa.Array:
    """Tokens of the texts as a list column; rows without a text have theirs in `words`."""
    given = words.to_pylist() if None in texts else []
    found = [[w for w in find(t.lower()) if w not in stopwords] if t is not None else given[i] or [] for i, t in enumerate(texts)]
    ends = np.cumsum([0, *map(len, found)])
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array([w for f in found for w in f], pa.string()))


def _worded(docs: DataFrame, text: str, profiles: Sequence[Profile], keep: Sequence[str]):
    """Rows with the columns `keep`, texts of ASCII characters for Python and tokens of the others; and what gives (kept columns, words) of a batch."""
    different = list({p.tokenizer: p for p in profiles}.values())
    plain = [p.token_pattern in PLAIN_PATTERNS for p in different]
    t = F.col("__text")
    ascii_only = F.coalesce((F.octet_length(t) == F.length(t)) & F.is_valid_utf8(t), F.lit(False))
    words = docs.select(*keep, F.col(text).cast("string").alias("__text")).select(
        *keep, F.when(ascii_only & F.lit(any(plain)), t).alias("__plain"),
        *((F.when(~ascii_only, tokens(t, p)) if simple else tokens(t, p)).alias(f"__words_{i}") for i, (p, simple) in enumerate(zip(different, plain))))
    find = [(re.compile(p.token_pattern, re.ASCII).findall, frozenset(p.stopwords)) if simple else None for p, simple in zip(different, plain)]
    n = len(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[pa.Array]]]:
        for batch in slices(batches):
            texts = batch.column(n).to_pylist() if any(plain) else []
            yield batch.columns[:n], [_words_of(texts, batch.column(n + 1 + i), *f) if f else batch.column(n + 1 + i) for i, f in enumerate(find)]

    return words, read, len(different)


def boxed_terms(docs: DataFrame, text: str, profiles: Sequence[Profile], keep: Sequence[str]) -> DataFrame:
    """What `packed_terms` gives, a slice of the texts to a record: n, kept, and BOXED columns of each different tokenizer.

    A term stands once in a slice and cells are numbers, so later passes read few strings.
    """
    words, read, different = _worded(docs, text, profiles, keep)
    names = [f"{c}_{i}" for i in range(different) for c in BOXED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, columns in read(batches):
            table = pa.RecordBatch.from_arrays(kept, names=list(keep))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_batch(table)
            boxes = [b for c in columns for b in _counted(c).boxed()]
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                                              *(pa.array([b], pa.binary()) for b in boxes)], names=["n", "kept", *names])

    return words.mapInArrow(run, f"n long, kept binary, {', '.join(f'{c} binary' for c in names)}")


def packed_terms(docs: DataFrame, text: str, profiles: Sequence[Profile], keep: Sequence[str]) -> DataFrame:
    """One row per document: the columns `keep`, and terms_i, counts_i, buckets_i for each different tokenizer i.

    Texts are read and cleaned once and go no further; nothing is shuffled.
    """
    words, read, different = _worded(docs, text, profiles, keep)
    kept = words.select(*keep).schema
    schema = T.StructType([*kept.fields, *(f for i in range(different) for f in (
        T.StructField(f"terms_{i}", T.ArrayType(T.StringType())), T.StructField(f"counts_{i}", T.ArrayType(T.IntegerType())),
        T.StructField(f"buckets_{i}", T.ArrayType(T.IntegerType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, columns in read(batches):
            yield pa.RecordBatch.from_arrays([*own, *(c for w in columns for c in _listed(_counted(w)))], names=schema.names)

    return words.mapInArrow(run, schema)


def _tokenizer(profiles: Sequence[Profile], profile: Profile) -> int:
    return list(dict.fromkeys(p.tokenizer for p in profiles)).index(profile.tokenizer)


def term_counts(docs: DataFrame, key: str, text: str, profile: Profile,
                extra: Sequence[str] = ()) -> DataFrame:
    """(key, extra.., term, tf), one row per document and term, from packed rows where they are."""
    rows = packed_terms(docs, text, [profile], [key, *extra])
    return rows.select(key, *extra, F.explode(F.arrays_zip("terms_0", "counts_0")).alias("t")).select(
        key, *extra, F.col("t.terms_0").alias("term"), F.col("t.counts_0").cast("long").alias("tf"))


# --- vocabularies ---------------------------------------------------------------------------

def vocabulary(counts: DataFrame, docs: DataFrame, profile: Profile) -> DataFrame:
    """Kept terms (term, df, total, idf), at most `max_features` of them, from (term, tf) rows."""
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return _kept_terms(stats, docs.agg(F.count(F.lit(1))).scalar(), profile)


def _kept_terms(stats: DataFrame, documents: Column, profile: Profile) -> DataFrame:
    """Terms outside the document-frequency limits go first; then the largest totals stay, ties by term."""
    kept = (stats.withColumn("__n", documents)
            .filter((F.col("df") >= profile.min_df) & (F.col("df") <= profile.max_df * F.col("__n"))))
    idf = F.log((F.lit(1.0) + F.col("__n")) / (F.lit(1.0) + F.col("df"))) + 1.0
    return (kept.withColumn("idf", idf).drop("__n")
            .orderBy(F.desc("total"), "term").limit(profile.max_features))


def _added_up(parts: list[pa.Table]) -> pa.Table:
    """One row per tokenizer and term."""
    both = pa.concat_tables(parts).group_by(["tokenizer", "term"], use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
    return both.select(["tokenizer", "term", "df_sum", "total_sum"]).rename_columns(["tokenizer", "term", "df", "total"])


def bucket_totals(rows: DataFrame, different: int) -> np.ndarray:
    """How often terms of each bucket stand in packed rows (tokenizer x bucket): no term stands there more often than its bucket."""
    piece = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((different, BUCKETS))
        for _, parts in _pieces(batches, different):
            for i, c in enumerate(parts):
                total[i] += np.bincount(c.buckets[c.codes], c.counts, BUCKETS)
        pieces = total.reshape(-1, piece)
        used = np.flatnonzero(pieces.any(axis=1))
        offsets = np.arange(len(used) + 1, dtype=np.int32) * piece
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(offsets, pieces[used].ravel())], names=["piece", "totals"])

    parts = _read(rows, [], range(different), names=False).mapInArrow(run, "piece int, totals array<double>").repartition("piece").groupBy("piece").agg(
        Summarizer.sum(array_to_vector("totals")).alias("totals"))
    out = np.zeros((different, BUCKETS))
    for row in parts.toLocalIterator():
        out.reshape(-1, piece)[row["piece"]] = row["totals"].toArray()
    return out


def partial_statistics(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(tokenizer, term, df, total) of the terms in wanted buckets (tokenizer x bucket).

    Tasks add up their own counts as far as HELD_TERMS rows reach.
    """
    different = len(wanted)
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(shared.value, axis=1).astype(bool)
        held: list[pa.Table] = []
        size = 0
        for _, parts in _pieces(batches, different):
            for i, c in enumerate(parts):
                inside = mask[i][c.buckets]
                df, total = (np.bincount(c.codes, w, len(inside)).astype(np.int64)[inside] for w in (None, c.counts))
                held.append(pa.table({"tokenizer": pa.array(np.full(len(total), i, np.int32)), "term": c.terms.filter(pa.array(inside)),
                                      "df": pa.array(df), "total": pa.array(total)}))
                size += len(total)
            if size >= HELD_TERMS:
                held = [_added_up(held)]
                size = held[0].num_rows
                if size > HELD_TERMS // 2:
                    yield from _term_batches(held)
                    held, size = [], 0
        if size:
            yield from _term_batches([_added_up(held)])

    return _read(rows, [], range(different)).mapInArrow(run, "tokenizer int, term string, df long, total long")


def _term_batches(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        for part in table.to_batches(max_chunksize=50_000):
            place = part.schema.get_field_index("term")
            yield part.set_column(place, "term", part.column(place).cast(pa.string()))


def vocabularies(rows: DataFrame, profiles: Sequence[Profile]) -> list[pa.Table]:
    """Vocabulary of every profile (term, df, total, idf) by term, from passes over packed rows.

    Terms are counted in the fullest buckets first. Where the last of `max_features` kept terms stands at least as
    often as all terms of any other bucket together, no term there can be kept; else the buckets that
    may hold one are counted as well. The result is that of counting all terms.
    """
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if _is_boxed(rows) else rows.count()
    different = len({p.tokenizer for p in profiles})
    totals = bucket_totals(rows, different)
    # a kept term stands in min_df documents at least
    least = np.full(different, np.iinfo(np.int64).max)
    limit = least.copy()
    for p in profiles:
        i, first = _tokenizer(profiles, p), p.max_features * BUCKETS_PER_FEATURE
        least[i] = min(least[i], max(p.min_df, 1))
        limit[i] = min(limit[i], np.sort(totals[i])[-first] if 0 < first < BUCKETS else 0)
    limit = np.maximum(limit, least)
    while True:
        stats = partial_statistics(rows, totals >= limit[:, None]).repartition("tokenizer", "term").groupBy("tokenizer", "term").agg(
            F.sum("df").alias("df"), F.sum("total").alias("total"))
        stored = materialize(stats.filter(F.col("df") >= min(p.min_df for p in profiles)), "terms")
        out = [_kept_terms(stored.filter(F.col("tokenizer") == _tokenizer(profiles, p)).drop("tokenizer"), F.lit(n), p).toArrow()
               for p in profiles]
        needed = limit.copy()
        for p, kept in zip(profiles, out):
            i = _tokenizer(profiles, p)
            enough = kept.num_rows == p.max_features > 0
            needed[i] = min(needed[i], max(least[i], pc.min(kept["total"]).as_py() if enough else 0))
        if (needed == limit).all():
            return [kept.sort_by("term") for kept in out]
        limit = needed


# --- weights --------------------------------------------------------------------------------

@dataclass(frozen=True)
class Fitted:
    """A fitted profile: vocabulary with column numbers, and rows of column numbers and weights."""

    vocabulary: DataFrame  # index, term, df, total, idf
    entries: DataFrame  # key, kept columns, indices, values
    size: int
    key: str
    keep: tuple[str, ...] = ()

    @property
    def weights(self) -> DataFrame:
        """(key, kept columns.., term, weight): one row per document and term; nothing is shuffled."""
        long = self.entries.select(self.key, *self.keep, F.explode(F.arrays_zip("indices", "values")).alias("e"))
        # at most `max_features` rows
        terms = F.broadcast(self.vocabulary.select("index", "term"))
        return (long.select(self.key, *self.keep, F.col("e.indices").alias("index"), F.col("e.values").alias("weight"))
                .join(terms, "index").select(self.key, *self.keep, "term", "weight"))

    def features(self) -> DataFrame:
        """Sparse ML vectors (key, features)."""
        return to_vectors(self.entries, self.key, self.size)


def weighed(rows: DataFrame, keep: Sequence[str], terms: pa.Array, idf: np.ndarray, tokenizer: int = 0, kept: T.StructType | None = None) -> DataFrame:
    """Packed rows as (keep.., indices, values): sublinear tf x idf of the vocabulary's terms, rows of length 1.

    Rows without such terms have empty arrays. `kept` is the schema of the kept columns where rows are boxed.
    """
    kept = kept or rows.select(*keep).schema
    schema = T.StructType([*kept.fields, T.StructField("indices", T.ArrayType(T.IntegerType())),
                           T.StructField("values", T.ArrayType(T.DoubleType()))])
    names = terms.cast(pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, (c,) in _pieces(batches, 1, len(kept)):
            place = pc.fill_null(pc.index_in(c.terms, names), -1).to_numpy(zero_copy_only=False)
            found = place[c.codes]
            known = found >= 0
            row, index, raw = c.rows[known], found[known], (1.0 + np.log(c.counts[known])) * idf[found[known]]
            length = np.sqrt(np.bincount(row, raw * raw, len(c.lengths)))
            order = np.lexsort((index, row))
            row, index, raw = row[order], index[order], raw[order]
            yield pa.RecordBatch.from_arrays(
                [*columns, _lists(row, len(c.lengths), pa.array(index.astype(np.int32))),
                 _lists(row, len(c.lengths), pa.array(raw / length[row]))], names=schema.names)

    return _read(rows, keep, [tokenizer], buckets=False).mapInArrow(run, schema)


def fit_all(docs: DataFrame, key: str, text: str, profiles: Sequence[Profile], keep: Sequence[str] = (),
            min_features: int = 0) -> list[Fitted]:
    """Fit several profiles in one scan of the texts; `keep` names columns that stay with every row.

    Packed rows and weights are written once to the shared folder, since later stages (SVD, KMeans,
    keywords, similarities) make many passes. Too few terms in a vocabulary raise ValueError.
    """
    spark = docs.sparkSession
    columns = list(dict.fromkeys([key, *keep]))
    rows, kept = materialize(boxed_terms(docs, text, profiles, columns), "terms-of-texts"), docs.select(*columns).schema
    out = []
    for profile, vocab in zip(profiles, vocabularies(rows, profiles)):
        if vocab.num_rows < min_features:
            raise ValueError(f"too few usable text features: {vocab.num_rows}, need {min_features}")
        table = vocab.add_column(0, "index", pa.array(np.arange(vocab.num_rows, dtype=np.int32)))
        entries = weighed(rows, columns, vocab["term"].combine_chunks(), vocab["idf"].to_numpy(), _tokenizer(profiles, profile), kept)
        out.append(Fitted(spark.createDataFrame(table), materialize(entries, "weights"), vocab.num_rows, key,
                          tuple(c for c in columns if c != key)))
    release(rows)
    return out


def fit(docs: DataFrame, key: str, text: str, profile: Profile, min_features: int = 10, keep: Sequence[str] = ()) -> Fitted:
    """Fit one profile; too few terms raise ValueError."""
    return fit_all(docs, key, text, [profile], keep, min_features)[0]


def tfidf(docs: DataFrame, key: str, text: str, profile: Profile = CATALOG,
          extra: Sequence[str] = ()) -> DataFrame:
    """Long TF-IDF table (key, extra.., term, weight); documents without kept terms have no rows."""
    return fit_all(docs, key, text, [profile], extra)[0].weights


def to_vectors(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, features): sparse ML vectors of (indices, values).

    They are written in the stored form of Spark's vector type and read back as such, so no row passes
    through Python or text.
    """
    stored = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), "indices", "values").alias("features")
    schema = T.StructType([rows.schema[key], T.StructField("features", VectorUDT())])
    return materialize(rows.select(key, stored), "vectors", schema)


# --- clusters -------------------------------------------------------------------------------

def cluster_term_means(weights: DataFrame, docs: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Mean weight of each term over all documents of a cluster (zeros count)."""
    sizes = docs.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    sums = weights.groupBy(cluster, "term").agg(F.sum("weight").alias("weight_sum"))
    return (sums.join(sizes, cluster)
            .select(cluster, "term", (F.col("weight_sum") / F.col("cluster_size")).alias("mean_weight")))


def cluster_keywords(weights: DataFrame, docs: DataFrame, limit: int = 12,
                     cluster: str = "cluster_id") -> DataFrame:
    """Terms of highest mean weight per cluster, as a `|` list; ties by term.

    Means keep 12 digits for ordering, so equal means tie.
    """
    means = (cluster_term_means(weights, docs, cluster).filter(F.col("mean_weight") > 0)
             .withColumn("__order", F.round("mean_weight", 12)))
    window = Window.partitionBy(cluster).orderBy(F.desc("__order"), "term")
    top = means.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)
    named = (top.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("items"))
             .select(cluster, F.array_join("items.term", " | ").alias("keywords")))
    return (docs.select(cluster).distinct().join(named, cluster, "left")
            .select(cluster, F.coalesce("keywords", F.lit("")).alias("keywords")))


def coherence(weights: DataFrame, docs: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Mean cosine of a cluster's documents to their mean vector; size <= 1 -> 0.

    Document rows have length 1 (or are empty), hence the mean cosine equals the
    length of the mean vector: sum(x.c)/(n|c|) = |c|. One sum per (cluster, term)
    replaces a join of every document with its centre.
    """
    lengths = (weights.groupBy(cluster, "term").agg(F.sum("weight").alias("s"))
               .groupBy(cluster).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length")))
    sizes = docs.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(F.col("length"), F.lit(0.0)) / F.col("n"))
    return sizes.join(lengths, cluster, "left").select(cluster, value.alias("semantic_coherence"))


def member_centres(entries: DataFrame, size: int, cluster: str = "cluster_id") -> dict[int, np.ndarray]:
    """Mean row of each cluster: sums per (cluster, column) combine map-side, one vector a cluster returns."""
    cells = entries.select(cluster, F.explode(F.arrays_zip("indices", "values")).alias("e"))
    sums = cells.groupBy(cluster, "e.indices").agg(F.sum("e.values").alias("s"))
    counts = entries.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).filter(F.col(cluster).isNotNull()).limit(
        CENTRE_VALUES // max(size, 1) + 1).toArrow()
    _check_centres(counts.num_rows, size)
    out = {c: np.zeros(size) for c in counts[cluster].to_pylist()}
    rows = sums.filter(F.col(cluster).isNotNull()).toArrow()
    owners, columns, values = rows[cluster].to_numpy(), rows["indices"].to_numpy(), rows["s"].to_numpy()
    for c, n in zip(counts[cluster].to_pylist(), counts["n"].to_pylist()):
        mine = owners == c
        out[c][columns[mine]] = values[mine] / n
    return out


def _check_centres(clusters: int, size: int) -> None:
    if clusters * size > CENTRE_VALUES:
        raise ValueError(f"centres of {clusters} clusters x {size} terms, more than {CENTRE_VALUES} values")


def centre_similarity(entries: DataFrame, centres: dict[int, np.ndarray], key: str, cluster: str = "cluster_id") -> DataFrame:
    """Cosine of each document to the centre of its cluster: (key, cluster, similarity).

    `entries` is (key, cluster, indices, values), `centres` cluster -> vector. A document without terms or
    cluster, or a zero centre, has similarity 0. Rows stay where they are; centres, of bounded size, go to
    the tasks.
    """
    _check_centres(len(centres), max((len(c) for c in centres.values()), default=0))
    place = {c: i for i, c in enumerate(centres)}
    matrix = np.array([*centres.values(), np.zeros(max((len(c) for c in centres.values()), default=1))])
    length = np.linalg.norm(matrix, axis=1)
    shared = entries.sparkSession.sparkContext.broadcast((place, matrix, length))
    schema = T.StructType([entries.schema[key], entries.schema[cluster], T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, matrix, length = shared.value
        for batch in slices(batches):
            index, row = _flat(batch.column(2))
            weight = _flat(batch.column(3))[0].to_numpy(zero_copy_only=False)
            own = np.array([place.get(c, len(place)) for c in batch.column(1).to_pylist()], np.int64)
            dot = np.bincount(row, weight * matrix[own[row], index.to_numpy(zero_copy_only=False)], batch.num_rows)
            scale = np.sqrt(np.bincount(row, weight * weight, batch.num_rows)) * length[own]
            value = np.divide(dot, scale, out=np.zeros(batch.num_rows), where=scale > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=schema.names)

    return entries.select(key, cluster, "indices", "values").mapInArrow(run, schema)
