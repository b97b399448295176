"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from segmentry.llm.common import bound_batches, table
from segmentry.session import materialize

# The base rules.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
#: Kind of the spans the method adds: random-looking strings that one owner has.
ADDED = "random"
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,}")

#: What stands in a masked secret's place.
MARK = "[SECRET]"
#: A value copied to more known owners than this is an example, however many documents each has.
LIVE_OWNERS = 1
#: Bits a character of an added value.
LIVE_BITS = 3.5

_SCHEMA = "doc_id long, owner string, digest string, found array<struct<kind: int, start: int, stop: int, value: binary>>"


_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary())]))
#: Columns that go with a row until its text is masked.
_DIGEST, _FOUND = "__text_digest", "__text_found"


def _listed_found(hits: list[tuple[int, int, int, str]]) -> list[dict]:
    """Candidates with a digest in the secret's place."""
    return [{"kind": k, "start": a, "stop": b, "value": hashlib.sha256(v.encode()).digest()[:16]} for k, a, b, v in hits]


def _bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) in code points; kinds are places in KINDS, 3 is an added one.

    Base matches run left to right without overlap per kind; those too short are dropped. Added
    candidates are long strings of upper case, lower case and digits, clear of all base matches.
    """
    out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for m in _RANDOM.finditer(text):
        v = m[0]
        if (any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)
                and _bits(v) >= LIVE_BITS and all(m.end() <= s or e <= m.start() for _, s, e, _ in out)):
            out.append((3, m.start(), m.end(), v))
    return sorted(out, key=lambda x: (x[1], x[0]))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """doc_id, owner, digest of the text, found: candidates of every whole text.

    Of a secret itself only a digest goes on. Null text has none; a null owner is unknown. Repeated rows stay. No shuffle.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_listed_found(candidates(x.as_py() or "")) for x in batch.column(2)]
            digest = [hashlib.sha256((x.as_py() or "").encode()).hexdigest() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.string()),
                                              pa.array(found, _ARROW)], names=["doc_id", "owner", "digest", "found"])

    return given.mapInArrow(run, _SCHEMA)


def _holds_candidates(text: Column) -> Column:
    """Whether a text has candidates, batch by batch; the rest of the row stays with Spark."""
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        return pa.array([bool(candidates(t.as_py() or "")) for t in texts], pa.bool_())

    return holds(text)


def _rows_with_candidates(docs: DataFrame) -> DataFrame:
    """The rows whose text has candidates, whole, with the digest of the text and what was found."""
    names = [*docs.columns, _DIGEST, _FOUND]
    schema = StructType([*docs.schema.fields, StructField(_DIGEST, StringType()), StructField(_FOUND, StructType.fromDDL(_SCHEMA)["found"].dataType)])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            hits = [candidates(t) for t in texts]
            rows = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
            digest = [hashlib.sha256(texts[i].encode()).hexdigest() for i in rows.to_pylist()]
            found = [_listed_found(hits[i]) for i in rows.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.array(digest, pa.string()), pa.array(found, _ARROW)], names=names)

    return docs.mapInArrow(run, schema)


def ownership(hits: DataFrame) -> DataFrame:
    """value, documents, owners, live: over the whole corpus, from one row per candidate.

    Owners are the known ones: a document of unknown owner makes no value an example. Counted in two steps, (value, owner, document) then value, so that a value copied very often or a
    source with a third of the documents combines map-side.
    """
    held = hits.select("value", "owner", "doc_id").distinct()
    per_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("documents"))
    counts = per_owner.groupBy("value").agg(F.sum("documents").alias("documents"), F.count("owner").alias("owners"))
    return counts.withColumn("live", F.col("owners") <= LIVE_OWNERS)


_SPANS = "array<struct<start:int,kind:int,stop:int,live:boolean,documents:bigint,owners:bigint>>"


def _spans(found: DataFrame, by: str) -> DataFrame:
    """Spans with their class per `by`: all base ones, added ones only where live."""
    hits = found.select(by, "doc_id", "owner", F.explode("found").alias("hit")).select(by, "doc_id", "owner", "hit.*")
    return (hits.join(ownership(hits), "value").filter((F.col("kind") < len(KINDS)) | F.col("live"))
            .groupBy(by).agg(F.sort_array(F.collect_set(F.struct(
                "start", "kind", "stop", "live", "documents", "owners"))).alias("spans")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Per document row: doc_id, spans as array of struct(start, kind, stop, live, documents, owners).

    Base matches stay whatever their class; an added candidate stays only when it is live: at most
    LIVE_OWNERS known owners hold it, in any number of documents. Texts are read once and not shuffled.
    """
    found = materialize(find(docs, doc_id, text, owner).withColumn("row", F.monotonically_increasing_id()), "candidates")
    return (found.select("row", "doc_id").join(_spans(found, "row"), "row", "left")
            .select("doc_id", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """`docs` with every live span of `text` replaced by `mark`; other rows and columns as they were.

    Copied examples stay. Spans meet their rows by a digest of the text, on which alone they depend, so
    repeated rows and null ids need no care. Rows with candidates, few in prose, are stored whole and join the
    spans: Spark broadcasts those only if their files are small, else it shuffles both. All other rows are
    passed on as they are. `docs` needs doc_id, source and text.
    """
    bound_batches(docs.sparkSession)
    clean, docs = docs.filter(~_holds_candidates(F.col("text"))), materialize(_rows_with_candidates(docs), "candidates")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("owner"),
                        F.col(_DIGEST).alias("digest"), F.col(_FOUND).alias("found"))
    live = F.filter("spans", lambda s: s["live"])
    cuts = materialize(_spans(found, "digest").select("digest", live.alias("cuts")).filter(F.size("cuts") > 0), "cuts")
    cuts = cuts.select(F.col("digest").alias("__digest"), F.col("cuts").alias("__cuts"))
    joined = docs.join(cuts, F.col(_DIGEST) == F.col("__digest"), "left")

    def cut(state: Column, span: Column) -> Column:
        kept = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        return F.when(span["start"] >= state["at"], F.struct(
            F.concat(state["out"], kept, F.lit(mark)).alias("out"), span["stop"].alias("at"))).otherwise(
            F.struct(state["out"].alias("out"), F.greatest(state["at"], span["stop"]).alias("at")))

    done = F.aggregate("__cuts", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut,
                       lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, 2**31 - 1)))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(done)
    return clean.unionByName(joined.withColumn("text", text).select(*clean.columns))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, ADDED)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; more columns: spans held to be live, spans copied widely."""
    found = scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
                        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"))
