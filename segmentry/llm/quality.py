"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from segmentry.llm.common import table
from segmentry.session import materialize

#: Rounds of exchange, and the probability from which a view's label is lent to the other view.
ROUNDS, CONFIDENT = 2, 0.97
#: Labelled rows that classifiers are fitted on: rows of least hash. All unlabelled rows may lend labels.
LABELLED = 40_000
#: Every such labelled row is held out for calibration.
HELD_OUT = 5
TEXT_SLOTS, META_SLOTS = 1 << 14, 1 << 10


def text_terms(text: Column) -> Column:
    """Distinct words, and distinct shapes of words: letters as a or A, digits as 0, other characters as they are."""
    words = F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    shape = lambda w: F.concat(F.lit("\u0001"), F.regexp_replace(F.regexp_replace(F.regexp_replace(
        w, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\d+", "0"))
    return F.concat(words, F.array_distinct(F.transform(words, shape)))


def meta_terms(docs: DataFrame, columns: list[str]) -> Column:
    """Terms of the page's metadata: each column's value, and the order of magnitude of numbers."""
    kinds = dict(docs.dtypes)
    number = lambda c: kinds[c] in ("bigint", "int", "double", "float")
    return F.array(*(F.concat_ws("=", F.lit(c), F.coalesce(
        F.floor(F.log2(F.greatest(F.col(c), F.lit(0)) + 1) * 2).cast("string") if number(c) else F.col(c).cast("string"),
        F.lit("\u0001none"))) for c in columns))


def _slots(terms: Column, size: int) -> Column:
    """The slots of terms, in order."""
    return F.array_sort(F.array_distinct(F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))))


def _vector(slots: str, size: int) -> Column:
    """Slots in the stored form of a sparse ML vector of ones."""
    return F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col(slots).alias("indices"),
                    F.transform(slots, lambda _: F.lit(1.0)).alias("values")).alias(slots)


def labelled_features(docs: DataFrame, labels: DataFrame, target: str, doc_id: str, text: str, metadata: list[str]) -> DataFrame:
    """doc_id, order, label, text, meta of every row, written once: the label (null: none) joins slots, not texts."""
    features = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _slots(text_terms(F.col(text)), TEXT_SLOTS).alias("text"),
                           _slots(meta_terms(docs, metadata), META_SLOTS).alias("meta"))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("label")).filter(
        "label in (0.0, 1.0) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = features.join(materialize(given, "labels"), "doc_id", "left").select(
        "doc_id", F.xxhash64("doc_id").alias("order"), "label", _vector("text", TEXT_SLOTS), _vector("meta", META_SLOTS))
    vector = lambda name: StructField(name, VectorUDT())
    return materialize(rows, "features", StructType([*rows.schema.fields[:3], vector("text"), vector("meta")]))


def _logit(view: str) -> Column:
    return vector_to_array(f"raw_{view}")[1]


def _fitted(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=view, labelCol="label", rawPredictionCol=f"raw_{view}", probabilityCol=f"prob_{view}",
                              predictionCol=f"pred_{view}", maxIter=25, regParam=1e-3, standardization=False).fit(rows)


def _calibrated(held: DataFrame, column: str) -> tuple[float, float]:
    """Slope and offset that turn a view's logit into a calibrated one, fitted on held-out labels."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[column], outputCol="x").transform(held.select(column, "label"))
    model = LogisticRegression(featuresCol="x", labelCol="label", maxIter=25, regParam=1e-4).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id", text: str = "text",
          metadata: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept of every document row; score is the chance of `target` = 1.

    Two logistic classifiers see only the words and only the metadata. In each round, labels that one view
    gives unlabelled documents with CONFIDENT or more train the other. Each view's logit is then
    calibrated on held-out labels, and the score adds both to the prior: logit = text + meta - prior.
    Null text is empty, null metadata a value of its own; labels that are null or not 0 or 1
    are ignored, a doc_id labelled twice takes the larger label. Without both labels every score is
    the labels' mean (0.5 without any). Kept from 0.5. Repeated rows stay; extra columns are ignored.

    Fitting takes at most LABELLED labelled rows, those of least hash of doc_id, and all unlabelled ones
    that a view is sure of; scoring takes all. Features and labels are joined and written once, texts are not
    shuffled; the rounds are maps over what was written.
    """
    rows = labelled_features(docs, labels, target, doc_id, text, list(metadata))
    marked = rows.filter("label is not null")
    cut = marked.select("order").distinct().orderBy("order").limit(LABELLED).agg(F.max("order")).first()[0]
    known = marked.filter(F.col("order") <= cut) if cut is not None else marked
    known = materialize(known.dropDuplicates(["doc_id"]), "known").persist()  # LABELLED rows
    train = known.filter(F.pmod(F.xxhash64("order"), F.lit(HELD_OUT)) > 0)
    held = known.filter(F.pmod(F.xxhash64("order"), F.lit(HELD_OUT)) == 0)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = [{r[0] for r in part.select("label").distinct().collect()} for part in (train, held)]
    mean = counts.get(1.0, 0) / sum(counts.values()) if counts else 0.5
    if any(len(b) < 2 for b in both):
        flat = F.lit(mean)
        return rows.select("doc_id", flat.alias("p_text"), flat.alias("p_meta"), flat.alias("score"), (flat >= 0.5).alias("kept"))

    # scored from what is stored in each round; a fit keeps its own blocks of the rows lent while it runs
    free = rows.filter("doc_id is not null and label is null").drop("label")
    models = {view: _fitted(train, view) for view in ("text", "meta")}
    for _ in range(ROUNDS):
        lent = {}
        for view in models:
            p = vector_to_array(f"prob_{view}")[1]
            sure = models[view].transform(free).withColumn("p", p).filter((F.col("p") >= CONFIDENT) | (F.col("p") <= 1 - CONFIDENT))
            lent[view] = sure.select("doc_id", "order", "text", "meta", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("label"))
        fit_on = {"text": lent["meta"], "meta": lent["text"]}
        models = {view: _fitted(train.unionByName(fit_on[view].select(train.columns)), view) for view in models}

    scored = held
    for view in models:
        scored = models[view].transform(scored).withColumn(f"l_{view}", _logit(view))
    scored = materialize(scored.select("label", "l_text", "l_meta"), "held")
    slopes = {view: _calibrated(scored, f"l_{view}") for view in models}
    known.unpersist()

    out = rows
    for view in models:
        slope, offset = slopes[view]
        out = models[view].transform(out).withColumn(f"c_{view}", _logit(view) * slope + offset)
    prior = F.lit(mean)
    logit = F.col("c_text") + F.col("c_meta") - F.log(prior / (1 - prior))
    chance = lambda x: 1 / (1 + F.exp(-x))
    return out.select("doc_id", chance(F.col("c_text")).alias("p_text"), chance(F.col("c_meta")).alias("p_meta"),
                      chance(logit).alias("score"), (logit >= 0).alias("kept"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored for quality."""
    return score(table(spark, folder, "documents"), table(spark, folder, "labels"))
