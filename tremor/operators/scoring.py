"""Scoring, prediction results, embedding and the classifier.

The reference's neural encoder and fusion MLP are not rebuilt; instead:
* ``embed`` runs a caller-supplied encoder over batches of non-blank posts
  (``mapInPandas``), or a char-bigram hashing embedding with sparse vectors;
* ``train_classifier`` fits a Spark ML multinomial logistic regression (or an
  MLP) on event vector ⊕ statistics, with class weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LEVEL_TO_LABEL, argmax, level_label, result_id, softmax
from ..functions.text import is_valid, truncate_len
from .cleaning import spread
from .sparse import bigram_vectors

# --- fixed values that must equal the reference: result columns -----------------
EVENT_RESULT = ["event_name", "predicted_class", "predicted_label", "probabilities"]
# -------------------------------------------------------------------------------
LABEL_NAMES = [LEVEL_TO_LABEL[i] for i in sorted(LEVEL_TO_LABEL)]


def score_events(events: DataFrame, logits: str = "logits") -> DataFrame:
    """Logits -> probabilities, class, label and the label->probability map."""
    return event_results(events.select("event", argmax(logits).alias("predicted_class"), softmax(logits).alias("probs")))


def event_results(scored: DataFrame) -> DataFrame:
    """(event, predicted_class, probs) -> the event result columns."""
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    return scored.select(
        F.col("event").alias("event_name"), "predicted_class", level_label("predicted_class").alias("predicted_label"),
        F.map_from_arrays(F.slice(names, 1, F.size("probs")), F.col("probs")).alias("probabilities"))


def post_results(posts: DataFrame, event_preds: DataFrame, text_col: str = "text") -> DataFrame:
    """Each non-blank post gets its event's class (copied, Q23).

    posts(event, pos, id, text) ⋈ event_preds(event_name|event, predicted_class,
    predicted_label) -> (event, id, text, predicted_class, predicted_label).
    """
    ev = "event_name" if "event_name" in event_preds.columns else "event"
    preds = event_preds.select(F.col(ev).alias("event"), "predicted_class", "predicted_label")
    return (posts.where(is_valid(text_col)).join(preds, "event")
            .select("event", result_id("id", "pos").alias("id"), F.col(text_col).alias("text"),
                    "predicted_class", "predicted_label"))


def batch_predict(requested: DataFrame, scored: DataFrame, reason: str = "event file not found",
                  errors: DataFrame | None = None) -> DataFrame:
    """Every requested event, with its prediction or an error string.

    ``errors(event, error)`` names events that failed for a known reason (for
    example a file without the text column); they get that error and no
    prediction. Other unscored events get ``reason``.
    """
    ev = "event_name" if "event_name" in scored.columns else "event"
    s = scored.select(F.col(ev).alias("event"), "predicted_class", "predicted_label", F.lit(True).alias("_ok"))
    out = requested.select("event").distinct().join(s, "event", "left")
    if errors is not None:
        out = out.join(errors.select("event", F.col("error").alias("_err")), "event", "left")
        failed = F.col("_err").isNotNull()
        return out.select("event",
                          F.when(~failed, F.col("predicted_class")).alias("predicted_class"),
                          F.when(~failed, F.col("predicted_label")).alias("predicted_label"),
                          F.coalesce(F.col("_err"), F.when(F.col("_ok").isNull(), F.lit(reason))).alias("error"))
    return out.select("event", "predicted_class", "predicted_label",
                      F.when(F.col("_ok").isNull(), F.lit(reason)).alias("error"))


# ----------------------------------------------------------------------------- E14

EMBED_DIM = 1 << 12  # hashed bigram buckets of the default embedding
ENCODE_BATCH = 512  # fixed value: posts given to an encoder at once, at most


def hashed_bigram_embedding(posts: DataFrame, text_col: str = "text", num_features: int = EMBED_DIM,
                            max_len: int | None = None) -> DataFrame:
    """Char bigrams -> HashingTF -> L2 norm by Spark ML, as whole arrays: the vectors of
    ``sparse.bigram_vectors`` for callers that need an array for each post.

    Only non-blank posts are embedded (blank ones are left to the caller as
    zero / invalid). ``max_len`` (P6) cuts posts first; by default whole texts are embedded.
    """
    from pyspark.ml.feature import HashingTF, NGram, Normalizer
    from pyspark.ml.functions import vector_to_array
    text = truncate_len(F.col(text_col), max_len)
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    src = posts.where(is_valid(text_col)).withColumn("_chars", chars)
    grams = NGram(n=2, inputCol="_chars", outputCol="_bigrams").transform(src)
    tf = HashingTF(inputCol="_bigrams", outputCol="_tf", numFeatures=num_features).transform(grams)
    emb = Normalizer(inputCol="_tf", outputCol="_emb", p=2.0).transform(tf)
    return emb.withColumn("vec", vector_to_array("_emb")).drop("_chars", "_bigrams", "_tf", "_emb")


def encode_batches(lengths: list[int], count: int, chars: int | None = None) -> list[list[int]]:
    """Places of the texts by length, in batches of at most ``count`` texts and ``chars`` characters (or one text)."""
    out: list[list[int]] = []
    held = 0
    for place in sorted(range(len(lengths)), key=lambda p: (lengths[p], p)):
        if not out or len(out[-1]) >= count or chars is not None and held + lengths[place] > chars:
            out.append([])
            held = 0
        out[-1].append(place)
        held += lengths[place]
    return out


def embed(posts: DataFrame, encoder: Callable | None = None, dim: int | None = None,
          text_col: str = "text", max_len: int | None = None, encoder_factory: Callable | None = None,
          batch_size: int = ENCODE_BATCH, batch_chars: int | None = None, sparse: bool = True, partitions: int | None = None) -> DataFrame:
    """Post vectors for non-blank posts.

    ``encoder(list[str]) -> sequence of float sequences`` is called with at most ``batch_size``
    posts and, given ``batch_chars``, at most that many characters (a longer post comes alone).
    Posts of an Arrow batch are grouped by length, so that those of a call are alike; vectors
    go back to their posts' places. ``encoder_factory()`` returns such an encoder and runs
    once per task, on the executor, so a model is loaded there instead of travelling with the task.
    Without either the hashed char-bigram embedding is used: sparse structs, or arrays
    with ``sparse=False``. ``partitions``: see ``cleaning.spread``.
    """
    posts = spread(posts, partitions)
    if encoder is None and encoder_factory is None:
        return bigram_vectors(posts, text_col, EMBED_DIM, max_len) if sparse else hashed_bigram_embedding(posts, text_col, max_len=max_len)
    if dim is None:
        raise ValueError("dim is required with a custom encoder")
    import pandas as pd
    src = posts.where(is_valid(text_col)).withColumn(text_col, truncate_len(F.col(text_col), max_len))
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    schema = StructType(list(src.schema.fields) + [StructField("vec", ArrayType(DoubleType()))])

    def run(batches):
        encode = encoder_factory() if encoder_factory is not None else encoder
        for pdf in batches:
            texts = pdf[text_col].tolist()
            vecs: list = [None] * len(texts)
            for places in encode_batches([len(t) for t in texts], batch_size, batch_chars):
                for place, v in zip(places, encode([texts[p] for p in places]), strict=True):
                    vecs[place] = list(map(float, v))
            yield pdf.assign(vec=pd.Series(vecs, index=pdf.index, dtype=object))
    return src.mapInPandas(run, schema)


# ----------------------------------------------------------------------------- E13

def train_classifier(train: DataFrame, features_col: str = "features", label_col: str = "label",
                     weight_col: str | None = "weight", classifier: str = "lr", max_iter: int = 100,
                     seed: int = 42, hidden: int = 256):
    """Fit a multinomial classifier; returns the fitted Spark ML model.

    ``features_col`` may be an ARRAY<DOUBLE> or an ML vector. ``classifier`` is
    ``'lr'`` (class-weighted logistic regression) or ``'mlp'`` (no weights).
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql.types import ArrayType
    df = train
    if isinstance(df.schema[features_col].dataType, ArrayType):
        df = df.withColumn(features_col, array_to_vector(F.col(features_col).cast("array<double>")))
    df = df.withColumn(label_col, F.col(label_col).cast("double"))
    if classifier == "lr":
        est = LogisticRegression(featuresCol=features_col, labelCol=label_col, family="multinomial",
                                 maxIter=max_iter, regParam=1e-4)
        if weight_col:
            est = est.setWeightCol(weight_col)
    elif classifier == "mlp":
        n_in = len(df.select(features_col).first()[0])
        n_out = int(df.agg(F.max(label_col)).first()[0]) + 1
        est = MultilayerPerceptronClassifier(featuresCol=features_col, labelCol=label_col,
                                             layers=[n_in, hidden, max(n_out, 3)], maxIter=max_iter, seed=seed)
    else:
        raise ValueError(f"unknown classifier: {classifier}")
    return est.fit(df)


def predict_classes(model, df: DataFrame, features_col: str = "features", label_col: str | None = "label") -> DataFrame:
    """Score with a fitted model -> (event, [true,] pred, logits/probabilities)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql.types import ArrayType
    if isinstance(df.schema[features_col].dataType, ArrayType):
        df = df.withColumn(features_col, array_to_vector(F.col(features_col).cast("array<double>")))
    out = model.transform(df)
    cols = ["event"]
    if label_col and label_col in df.columns:
        cols.append(F.col(label_col).cast("int").alias("true"))
    return out.select(*cols, F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability").alias("probability"))
