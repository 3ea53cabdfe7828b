"""The three user flows, each one lazy DataFrame plan over all events at once.

* ``prepare_corpus``  - read every event file, type and clean posts, compute
  the 12 statistics, optionally through the cleaned-post cache (S1-S5, T*, A*).
* ``train_and_evaluate`` - labels, stratified split, event vectors (post
  embedding -> pooling -> ⊕ statistics), class-weighted classifier, metrics.
* ``predict_events`` - score events, emit event results, post results and
  per-event errors (E11, E12, J6).

Shuffles happen only on ``event`` (and the small label / split tables).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MAX_LEN, MAX_TWEETS, topic_sentence
from ..operators import features as A
from ..operators.cleaning import clean_posts
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import pooling as V
from ..operators import profile as PR
from ..operators import scoring as E
from ..operators import sparse as SP
from ..operators import windows as W
from ..session import ensure_checkpoint_dir
from ..sources import files as IO

POOLINGS = ("mean", "max", "cls", "attentive")


@dataclass
class Corpus:
    posts: DataFrame      # event, pos, id, text (raw), clean_text, nickname, ...
    features: DataFrame   # event + 12 statistics + top_location
    catalogue: DataFrame  # event, path, root_rank
    images: DataFrame | None = None  # event, id, path, ext: the image picked for a post
    errors: DataFrame | None = None  # event, root_rank, error: files that could not be read

    def modality(self) -> DataFrame:
        """Per event, posts with text and image, text only, neither."""
        if self.images is None:
            raise ValueError("prepare the corpus with images=True")
        posts = self.posts.select("event", "id", F.col("clean_text").alias("text"))
        return PR.modality_mix(PR.attach_images(posts, self.images))


def prepare_corpus(spark: SparkSession, roots: str | list[str], default_year: int | None = None,
                   cache_path: str | None = None, events: DataFrame | None = None, images: bool = False,
                   partitions: int | None = None) -> Corpus:
    """Read, type and clean all event posts; compute per-event statistics.

    A file that cannot be read (vanished, not UTF-8, an unclosed quote, no text column) is
    in ``errors`` and has no posts; the others go on. ``partitions``: see ``cleaning.spread``.

    The listing names the files to read (first root that has an event's file);
    with a cache, only those of events that are not in it are parsed. ``images``
    lists the events' image files too and picks one for each post (S12), reading
    signatures to skip unreadable ones.
    """
    cat = IO.event_files(spark, roots)
    if events is not None:
        cat = cat.join(events.select("event"), "event", "left_semi")
    # The cleaned posts become a written table once (the cache, or a landing
    # folder under the shared checkpoint dir); statistics, vectors and post
    # results all read it instead of re-parsing CSVs and re-running the regexes.
    if cache_path:
        todo = cat.join(IO.cached_events(spark, cache_path).select("event").distinct(), "event", "left_anti")
        posts, errors = IO.ingest(spark, todo)
        readable = cat.join(errors, ["event", "root_rank"], "left_anti")
        cleaned = IO.cleaned_cache(spark, posts, cache_path, "text", requested=readable, partitions=partitions)
    else:
        posts, errors = IO.ingest(spark, cat)
        cleaned = IO.land(clean_posts(posts, "text", "clean_text", partitions), "posts")
    features = A.event_features(cleaned, default_year, catalogue=cat)
    picked = PR.pick_images(IO.image_manifest(spark, roots, verify=True)) if images else None
    return Corpus(cleaned, features, cat, picked, errors)


def event_vectors(corpus: Corpus, pooling: str = "mean", encoder: Callable | None = None, dim: int | None = None,
                  max_posts: int = MAX_TWEETS, max_len: int | None = MAX_LEN, score: Callable | None = None,
                  add_topic: bool = True, use_stats: bool = True, drop_p: float = 0.0, seed: int = 42, epoch: int = 0,
                  encoder_factory: Callable | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(event, features ARRAY<DOUBLE>): pooled post vectors, followed by the 12 statistics with ``use_stats``.

    Posts are capped per event before embedding (only non-blank posts are
    embedded). ``drop_p`` drops posts at random, keeping one per event (R2, for
    training). ``add_topic`` puts the sentence `Topic: {event}` first (P7).
    ``pooling`` in mean / max / cls / attentive. For attentive pooling
    ``weights`` is the score network (``pooling.attention_score``); without it
    ``score(vec_col) -> Column`` gives the per-post score (default: the vector's L2 norm).
    """
    if pooling not in POOLINGS:
        raise ValueError(f"unknown pooling: {pooling}")
    posts = corpus.posts.select("event", F.col("pos").cast("long").alias("pos"), "id", F.col("clean_text").alias("text"))
    capped = W.cap_posts(posts, max_posts).select("event", "pos", "id", "text")
    if drop_p > 0:
        capped = W.drop_posts(capped, drop_p, seed, epoch)
    if add_topic:
        topics = corpus.features.select("event", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"),
                                        topic_sentence("event").alias("text"))
        capped = capped.unionByName(topics)
    # the default embedding stays sparse up to the pool; a caller's score function is given arrays
    emb = E.embed(capped, encoder=encoder, dim=dim, max_len=max_len, encoder_factory=encoder_factory,
                  sparse=score is None or pooling != "attentive").withColumn("valid", F.lit(True))
    if pooling == "mean":
        pooled = V.mean_pool(emb)
    elif pooling == "max":
        pooled = V.max_pool(emb)
    elif pooling == "cls":
        pooled = V.cls_pool(emb)
    else:
        if weights is not None:
            emb = V.attention_score(emb, weights)
        else:
            stored = "vec.values" if SP.is_sparse(emb, "vec") else "vec"
            emb = emb.withColumn("score", score(F.col("vec")) if score else F.sqrt(F.aggregate(stored, F.lit(0.0), lambda a, x: a + x * x)))
        pooled = V.attentive_pool(emb)
    # events without any embedded post get a zero text vector of the same width
    width = int(dim) if encoder is not None or encoder_factory is not None else E.EMBED_DIM
    stats = V.stats_array(corpus.features, A.FEATURES)
    joined = stats.join(pooled.select("event", F.col("vec").alias("tv")), "event", "left")
    text = F.coalesce("tv", F.array_repeat(F.lit(0.0), F.lit(width)))
    return joined.select("event", (F.concat(text, F.col("vec")) if use_stats else text).alias("features"))


def train_and_evaluate(corpus: Corpus, labels: DataFrame, split: DataFrame | None = None, train_ratio: float = 0.8,
                       seed: int = 42, pooling: str = "mean", classifier: str = "lr", class_counts: list[int] | None = None,
                       encoder: Callable | None = None, dim: int | None = None, max_iter: int = 50,
                       strict: bool = True, drop_p: float = 0.0, **vectors):
    """Fit on the train part, evaluate on val. Returns (model, predictions, metrics, split).

    With a given ``split`` and ``strict``, split events without an event file
    raise (J2), as the reference's loader does; otherwise they are left out.
    ``drop_p`` drops posts of the train part only; other keyword arguments go
    to ``event_vectors``. ``metrics`` has one row per part: accuracy, macro
    precision, recall and F1, weighted F1 and loss (train: class-weighted
    smoothed cross-entropy, val: cross-entropy), the val row first.
    """
    lab = L.encode_labels(L.dedupe_labels(labels))
    if split is None:
        split = L.stratified_split(corpus.catalogue, lab, train_ratio, seed)
    elif strict:
        L.missing_events(split, corpus.catalogue, strict=True)
    # one row per event, read by the fit and by the scoring: embed once
    ensure_checkpoint_dir(corpus.posts.sparkSession)
    vecs = event_vectors(corpus, pooling, encoder, dim, **vectors).checkpoint()
    table = L.join_labels(vecs, lab).join(split.select("event", "part"), "event")
    weights = L.class_weights(lab.join(split.where(F.col("part") == "train").select("event"), "event"), class_counts)
    table = table.join(weights.select("level", "weight"), "level", "left").fillna({"weight": 1.0})
    table = table.select("event", "part", "features", F.col("level").alias("label"), "weight")
    train = table.where(F.col("part") == "train")
    fitted = train
    if drop_p > 0:
        thinned = event_vectors(corpus, pooling, encoder, dim, drop_p=drop_p, seed=seed, **vectors)
        fitted = train.drop("features").join(thinned, "event")
    model = E.train_classifier(fitted, classifier=classifier, max_iter=max_iter, weight_col="weight" if classifier == "lr" else None)
    val = table.where(F.col("part") == "val")
    preds = E.predict_classes(model, val).select("event", "true", "pred")
    report = part_metrics(model, val, "val").unionByName(part_metrics(model, train, "train", class_counts, weighted=True))
    return model, preds, report, split


def part_metrics(model, rows: DataFrame, part: str, class_counts: list[int] | None = None, weighted: bool = False) -> DataFrame:
    """One row of metrics and loss of a fitted model over labelled event vectors."""
    scored = E.predict_classes(model, rows)
    # log-probabilities are logits up to a constant, which the loss does not see
    logits = scored.select(F.col("true").alias("y"), F.transform("probability", lambda p: F.log(F.greatest(p, F.lit(1e-12)))).alias("logits"))
    loss = M.weighted_smoothed_cross_entropy(logits, counts=class_counts) if weighted else M.cross_entropy(logits)
    one = F.lit(part).alias("part")
    pred = scored.select("event", "true", "pred")
    return (M.macro_metrics(pred).select(one, "*").join(M.weighted_metrics(pred).select(one, "weighted_f1"), "part")
            .join(loss.select(one, "loss"), "part"))


def predict_events(spark: SparkSession, model, corpus: Corpus, requested: DataFrame | None = None,
                   pooling: str = "mean", encoder: Callable | None = None, dim: int | None = None,
                   max_posts: int = MAX_TWEETS, **vectors):
    """Score every event. Returns (event_results, post_results, batch_status).
    ``vectors``: further arguments of ``event_vectors``, as in training."""
    # a file without the text column fails in the reference; report it
    errors = None if corpus.errors is None else corpus.errors.groupBy("event").agg(F.min("error").alias("error"))
    if errors is None and "has_text" in corpus.posts.columns:
        errors = (corpus.posts.groupBy("event").agg(F.max(F.col("has_text").cast("int")).alias("_t"))
                  .where(F.col("_t") == 0).select("event", F.lit("no text column").alias("error")))
    vecs = event_vectors(corpus, pooling, encoder, dim, max_posts=max_posts, **vectors)
    if errors is not None:
        vecs = vecs.join(errors, "event", "left_anti")
    scored = E.predict_classes(model, vecs, label_col=None)
    # event results feed the JSON, the post results and the batch status: score once
    ensure_checkpoint_dir(spark)
    events = E.event_results(scored.select("event", F.col("pred").alias("predicted_class"), F.col("probability").alias("probs"))).checkpoint()
    posts = W.cap_posts(corpus.posts.select("event", "pos", "id", F.col("clean_text").alias("text")), max_posts)
    post_res = E.post_results(posts, events)
    req = requested if requested is not None else corpus.catalogue.select("event")
    status = E.batch_predict(req, events, errors=errors)
    return events, post_res, status
