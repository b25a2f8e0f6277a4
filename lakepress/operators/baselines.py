"""Baseline models with spark.ml, cross-fold prediction, containment."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, IndexToString, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lakepress.functions import keywords as K
from lakepress.operators.metrics import class_weights
from lakepress.plans.workdir import spill

Fitted = Callable[[DataFrame], DataFrame]
#: of training rows, the label's column and the fold that is held out
Model = Callable[[DataFrame, str, Any], Fitted | None]

FEATURES = 50_000
#: texts that a gram occurs in, at least
MIN_DF = 2
#: passages of one or two words
SHORT = 100
#: the regression stops when it has converged, or here
ROUNDS = 300
#: folds that are fitted side by side
AT_ONCE = 5


def _weighted(train: DataFrame, label: str) -> DataFrame:
    return train.join(class_weights(train.select(label), label).select(label, "weight"), label)


def _pipeline(train: DataFrame, label: str, stages: list) -> Fitted:
    """Balanced logistic regression whose penalty weighs as much as one row, as in an unscaled sum of losses."""
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    n = max(train.count(), 1)
    lr = LogisticRegression(featuresCol="features", labelCol="__y", weightCol="weight", predictionCol="__p", maxIter=ROUNDS, tol=1e-4, regParam=1.0 / n, standardization=False)
    name = IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels)
    fitted = Pipeline(stages=[*stages, lr]).fit(index.transform(_weighted(train, label)))
    return lambda rows: name.transform(fitted.transform(rows))


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the same letters without, by their canonical decompositions."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def plain(text: Column) -> Column:
    """Lower case without accents; marks that stand alone go too."""
    marked, bare = _accents()
    return F.regexp_replace(F.translate(F.lower(text), marked, bare), r"\p{Mn}+", "")


def gram_counts(rows: DataFrame, key: str, text: str = "text", *by: str) -> DataFrame:
    """(key, by..., gram, tf) of words of two characters or more and of pairs of such words; a key's grams are counted where its text lies."""
    words = F.regexp_extract_all(plain(F.col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    met = rows.where(F.col(text).isNotNull()).select(key, *by, text).repartition(key)
    each = met.select(key, *by, words.alias("w")).select(key, *by, F.explode(F.concat("w", pairs)).alias("gram"))
    return each.groupBy(key, *by, "gram").agg(F.count(F.lit(1)).alias("tf"))


def fold_vocabularies(counts: DataFrame, sizes: dict, fold: str) -> DataFrame:
    """(gram, at, idf_0, ...): grams of the vocabulary of any fold's model, numbered, and their idf in each, null where it does not hold them.

    A model sees the rows of all other folds: its frequencies are those of all
    rows less the fold's own, so one pass over ``counts`` serves every fold.
    ``sizes`` are the rows of each fold.
    """
    own = lambda f, what: F.sum(F.when(F.col(fold) == f, what).otherwise(0))
    sums = [c for i, f in enumerate(sizes) for c in (own(f, F.lit(1)).alias(f"df_{i}"), own(f, F.col("tf")).alias(f"total_{i}"))]
    seen = spill(counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), *sums).where(F.col("df") >= MIN_DF), "frequencies")
    best = None
    for i, f in enumerate(sizes):
        n = sum(sizes.values()) - sizes[f]
        others = seen.select("gram", (F.col("df") - F.col(f"df_{i}")).alias("df"), (F.col("total") - F.col(f"total_{i}")).alias("total"))
        part = others.where(F.col("df") >= MIN_DF).orderBy(F.desc("total"), "gram").limit(FEATURES)
        part = part.select("gram", F.lit(i).alias("of"), (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
        best = part if best is None else best.unionByName(part)
    wide = best.groupBy("gram").agg(*[F.max(F.when(F.col("of") == i, F.col("idf"))).alias(f"idf_{i}") for i in range(len(sizes))])
    # at most FEATURES rows a fold
    return spill(wide.withColumn("at", F.row_number().over(Window.orderBy("gram")) - 1), "vocabulary")


def text_model(rows: DataFrame, key: str = "doc_id", fold: str = "fold", text: str = "text") -> tuple[DataFrame, Model]:
    """Single words and pairs that two texts hold at least, the most frequent; (1 + ln tf) times smooth idf, scaled to length one.

    Gives ``rows`` with a vector of 1 + ln tf in place of the text, and the
    model to predict them by. Vocabulary and idf of a fold's model are those of
    its training rows alone; the vectors, which all folds share, hold the grams
    of every vocabulary, and the model's idf is zero for those of others.
    """
    sizes = {r[0]: r[1] for r in sorted(rows.groupBy(fold).count().where(F.col(fold).isNotNull()).collect())}
    if not sizes:
        return rows.drop(text), lambda train, label, held: None
    counts = spill(gram_counts(rows, key, text, fold), "grams")
    vocabulary = fold_vocabularies(counts, sizes, fold)
    known = vocabulary.orderBy("at").drop("gram", "at").toPandas().fillna(0.0).to_numpy()
    scales = {f: known[:, i] for i, f in enumerate(sizes)}
    cells = counts.join(F.broadcast(vocabulary.select("gram", "at")), "gram").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", F.col("tf").cast("int").alias("tf")))).alias("x"))
    found = cells.select(key, F.col("x.at").alias("at"), F.transform("x", lambda c: 1 + F.log(c["tf"].cast("double"))).alias("w"))
    # the form in which a sparse vector is stored
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(len(known)).alias("size"), F.coalesce("at", F.array().cast("array<int>")).alias("indices"), F.coalesce("w", F.array().cast("array<double>")).alias("values")
    )
    joined = rows.drop(text).join(found, key, "left").select(*[c for c in rows.columns if c != text], vector.alias("counts"))
    shared = spill(joined, "vectors", StructType([StructField("counts", VectorUDT()) if f.name == "counts" else f for f in joined.schema]))

    def fit(train: DataFrame, label: str, held) -> Fitted:
        idf = ElementwiseProduct(scalingVec=Vectors.dense(scales[held]), inputCol="counts", outputCol="__weighed")
        return _pipeline(train, label, [idf, Normalizer(inputCol="__weighed", outputCol="features")])

    return shared, fit


def keyword_model(rows: DataFrame, groups: K.Groups, text: str = "text") -> tuple[DataFrame, Model]:
    """``rows`` with keyword features in place of the text, counted once for all folds, and the model to predict them by."""
    cols = [f"log1p_{g}" for g in groups]
    counted = spill(rows.select(*[c for c in rows.columns if c != text], *K.features(F.col(text), groups)), "keywords")

    def fit(train: DataFrame, label: str, held) -> Fitted:  # noqa: ARG001
        return _pipeline(train, label, [VectorAssembler(inputCols=cols, outputCol="features")])

    return counted, fit


def has_body_model(train: DataFrame, label: str, held=None) -> Fitted | None:  # noqa: ARG001
    """None where the flag is constant, as there is nothing to learn from it."""
    ends = train.agg(F.min("has_body").alias("low"), F.max("has_body").alias("high")).first()
    if ends.low == ends.high:
        return None
    add = lambda df: df.withColumn("__flag", F.col("has_body").cast("double"))
    fitted = _pipeline(add(train), label, [VectorAssembler(inputCols=["__flag"], outputCol="features")])
    return lambda rows: fitted(add(rows))


def cross_predict(rows: DataFrame, key: str, fold: str, label: str, model: Model) -> DataFrame:
    """(key, fold, label, predicted): every row predicted by a model that saw only other folds; a fold whose model has nothing to learn from is left out.

    Every fold reads ``rows`` several times, so they should be a written table.
    A fit is many short jobs one after another; those of several folds run side by side.
    """
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    one = lambda f: model(rows.where(F.col(fold) != f), label, f)
    with ThreadPool(max(1, min(len(folds), AT_ONCE))) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(one), folds)
    out = None
    for f, fitted in zip(folds, models, strict=True):
        if fitted is None:
            continue
        part = fitted(rows.where(F.col(fold) == f)).select(key, fold, label, "predicted")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(key, fold, label, F.lit(None).cast("string").alias("predicted")).limit(0)


def containing(docs: DataFrame, passages: DataFrame, words: int = 12, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item) of texts that contain a passage whole, candidates meeting on a window of blank-separated words.

    A passage's first and last word may be glued to what stands beside it, so
    its window lies between them: ``words`` words, or all inner words of a
    shorter passage. Windows of the corpus meet the passages before anything
    is shuffled for distinctness. Passages without an inner word are compared
    with every text; there may be ``SHORT`` of them.
    """
    split = lambda c: F.split(F.col(c), r"[ \n]")
    sized = passages.withColumn("__n", F.least(F.size(split("passage")) - 2, F.lit(words)))
    found = None
    for n in sorted(r[0] for r in sized.where("__n > 0").select("__n").distinct().collect()):
        window = F.xxhash64(F.array_join(F.slice(split("passage"), 2, n), " "))
        at = F.sequence(F.lit(1), F.greatest(F.size("__w") - n + 1, F.lit(1)))
        hashed = F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("__w", i, n), " ")))  # noqa: B023 - used in this round alone
        windows = docs.withColumn("__w", split("text")).select(key, F.explode(hashed).alias("__h"))
        met = windows.join(sized.where(F.col("__n") == n).select(item, "passage", window.alias("__h")), "__h").select(key, item, "passage").distinct()
        part = docs.join(met, key).where(F.contains("text", F.col("passage"))).select(key, item)
        found = part if found is None else found.unionByName(part)
    short = sized.where("__n <= 0").select(item, "passage").limit(SHORT + 1).collect()
    if len(short) > SHORT:
        raise ValueError(f"more than {SHORT} passages have no inner word")
    for r in short:
        part = docs.where(F.contains("text", F.lit(r["passage"]))).select(key, F.lit(r[item]).alias(item))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.join(passages.select(item).limit(0), F.lit(False)).select(key, item)
