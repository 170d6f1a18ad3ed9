"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Method: words are lower-cased and hashed, whole and by their first bytes, into one embedding table; a word's vector is
the sum of its rows. Filters of several widths slide over the word vectors, each keeps its greatest response in the text
(max pooling), and a logistic layer gives the score. Thresholds are calibrated by language on rows kept from the training.

Whole texts are scored, a batch of rows at a time in one vectorised pass: word bounds from byte classes, hashes from
prefix sums of a polynomial, modulo 2^64. At scoring the embeddings and filters are one matrix product per chunk of words.

The driver trains on a bounded sample: at most ``max_per_label`` labelled documents of each label, those least by a hash of the
doc_id, and of these, in the order of another hash, as many as hold ``max_train_bytes`` of text together; the executors apply both
bounds. Of rows that repeat a doc_id the shortest is learnt. Defined cases: null and empty texts have no words, pool to
zero and get a score like any other; labels other than 0 and 1, null labels and labels without a document are left out;
repeated labels of a document count once, toxic if any is; without labels of both kinds the score is 0.5 for every row and the threshold 1, so none is rejected;
a null or unknown language has the common threshold; empty tables give an empty result. The score depends on the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import settle, small_batches, table, text_of
from .words import Scan, grouped

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 12, (1, 2, 3), 10
PREFIXES = (3, 5, 6, 7)
MAX_PER_LABEL, MAX_TRAIN_BYTES, EPOCHS = 4000, 24 << 20, 6
SEED = 11


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, bounds): a row of bucket numbers per word (whole, then each prefix), and where each text's words begin, with the end."""
    scan = Scan(texts)
    out = np.empty((len(scan.starts), 1 + len(PREFIXES)), np.int32)
    for j, first in enumerate((1 << 40, *PREFIXES)):
        out[:, j] = scan.hashes(first, j * 7919) & np.uint64(BUCKETS - 1)
    return out, scan.bounds


def hash_in_parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """hash_words of many texts, a bounded part at a time: the tables of hash_words are 40 times as large as its text.

    The features go into one array with room for a word per two bytes; what is not written to takes no memory."""
    counts, used = np.zeros(len(texts) + 1, np.int64), 0
    out = np.empty((sum(len(t) + 3 for t in texts) // 2 + 1, 1 + len(PREFIXES)), np.int32)
    for owners, group in grouped(texts, 1 << 20):
        features, bounds = hash_words(group)
        out[used : used + len(features)] = features
        used += len(features)
        np.add.at(counts, np.array(owners) + 1, np.diff(bounds))
    return out[:used], np.cumsum(counts)


class Model:
    """Embeddings E (buckets x DIM), filters W (width, DIM, FILTERS) with bias, and the logistic layer."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.w = {k: rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.scale, self.shift = 1.0, 0.0  # calibration of the logit
        self.trained = False

    def pool(self, features: np.ndarray, bounds: np.ndarray, where: bool = False):
        """Max pooled responses (texts x filters), those of no window 0; with where, also the word at which each maximum starts (-1: none)."""
        n, m = len(bounds) - 1, len(features)
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(pooled.shape, -1, np.int64)
        x = np.zeros((m, DIM), np.float32)
        for j in range(features.shape[1]):
            x += self.e[features[:, j]]
        owner = np.repeat(np.arange(n), np.diff(bounds))
        for c, k in enumerate(WIDTHS):
            count = m - k + 1
            if count <= 0:
                continue
            y = x[:count] @ self.w[k][0]
            for j in range(1, k):
                y += x[j : count + j] @ self.w[k][j]
            y += self.b[k]
            whole = owner[:count] == owner[k - 1 :]  # a window stays in one text
            if not whole.all():
                y[~whole] = -np.inf
            has = np.flatnonzero(np.diff(bounds) >= k)
            if not len(has):
                continue
            firsts = bounds[has]
            best = np.maximum.reduceat(y, firsts, axis=0)
            if where:
                low = firsts[0]  # texts before it have fewer than k words
                hit = y[low:] == np.repeat(best, np.diff(np.append(firsts, count)), axis=0)
                rows, cols = np.nonzero(hit)
                rows += low
                text = owner[rows]
                spot = np.full((n, FILTERS), -1, np.int64)
                spot[text[::-1], cols[::-1]] = rows[::-1]  # the first of equals
                at[:, c * FILTERS : (c + 1) * FILTERS] = np.where(best_of(best, has, n) > 0, spot, -1)
            pooled[has, c * FILTERS : (c + 1) * FILTERS] = np.maximum(best, 0)
        return (pooled, at) if where else pooled

    def logits(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pool(features, bounds) @ self.out + self.bias

    def scores(self, texts: list[bytes], chunk: int = 2 << 20) -> np.ndarray:
        """Scores. About ``chunk`` bytes are worked on at once: texts together, or pieces of a longer one, whose maxima meet."""
        if not self.trained:
            return np.full(len(texts), 0.5)
        pooled = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        for owners, group in grouped(texts, chunk, max(WIDTHS) - 1):
            np.maximum.at(pooled, owners, self.pool(*hash_words(group)))
        z = pooled @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * z.astype(np.float64) + self.shift, -60, 60)))


def best_of(best: np.ndarray, has: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, best.shape[1]), np.float32)
    out[has] = best
    return out


def train(texts: list[bytes], toxic: np.ndarray, *, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.03, seed: int = SEED) -> Model:
    """Adagrad on log loss; only the words at the maxima pass gradients, so updates of the table are sparse."""
    model, rng = Model(seed), np.random.default_rng(seed)
    toxic = np.asarray(toxic, np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return model
    model.trained = True
    weight = np.where(toxic == 1, min(4.0, float((toxic == 0).sum() / max(1, (toxic == 1).sum()))), 1.0).astype(np.float32)
    features, bounds = hash_in_parts(texts)
    acc = {"e": np.full(BUCKETS, 1e-3, np.float32), "out": np.full(model.out.shape, 1e-3, np.float32), "bias": np.float32(1e-3)}
    acc |= {("w", k): np.full(model.w[k].shape, 1e-3, np.float32) for k in WIDTHS} | {("b", k): np.full(FILTERS, 1e-3, np.float32) for k in WIDTHS}

    def step(key, value, grad):
        acc[key] += grad * grad
        return value - rate * grad / np.sqrt(acc[key])

    steps = max(epochs, -(-150 * batch // len(texts)))  # small samples are gone through more often
    for _ in range(min(steps, 10 * epochs)):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            ids = order[i : i + batch]
            sizes = bounds[ids + 1] - bounds[ids]
            rows = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in ids]) if sizes.sum() else np.zeros(0, np.int64)
            f, b = features[rows], np.concatenate(([0], np.cumsum(sizes)))
            pooled, at = model.pool(f, b, where=True)
            z = pooled @ model.out + model.bias
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic[ids]) * weight[ids] / len(ids)
            back = np.where(at >= 0, g[:, None] * model.out[None, :], 0).astype(np.float32)
            words, grads = [], []
            for c, k in enumerate(WIDTHS):
                part, spot = back[:, c * FILTERS : (c + 1) * FILTERS], at[:, c * FILTERS : (c + 1) * FILTERS]
                t, j = np.nonzero(spot >= 0)
                where, d = spot[t, j], part[t, j]
                gw = np.zeros_like(model.w[k])
                for o in range(k):
                    x = model.e[f[where + o]].sum(1)
                    for col in range(FILTERS):
                        gw[o, :, col] = (d[j == col][:, None] * x[j == col]).sum(0)
                    words.append(f[where + o])
                    grads.append(d[:, None] * model.w[k][o][:, j].T)
                model.w[k] = step(("w", k), model.w[k], gw)
                model.b[k] = step(("b", k), model.b[k], np.bincount(j, d, FILTERS).astype(np.float32))
            model.out = step("out", model.out, (pooled * g[:, None]).sum(0).astype(np.float32))
            model.bias = step("bias", model.bias, np.float32(g.sum()))
            if words and sum(map(len, words)):
                idx, inverse = np.unique(np.concatenate(words), return_inverse=True)
                full = np.repeat(np.concatenate(grads), features.shape[1], axis=0)
                sums = np.zeros((len(idx), DIM), np.float32)
                np.add.at(sums, inverse.ravel(), full)
                acc["e"][idx] += (sums * sums).mean(1)
                model.e[idx] -= rate * sums / np.sqrt(acc["e"][idx])[:, None]
    return model


def calibrate(model: Model, logits: np.ndarray, toxic: np.ndarray) -> None:
    """Platt scaling by Newton steps, with a little pull to scale 1."""
    if not len(logits) or toxic.min() == toxic.max():
        return
    a, b = 1.0, 0.0
    x = logits.astype(np.float64)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        r, w = p - toxic, p * (1 - p) + 1e-6
        grad = np.array([(r * x).sum() + 0.5 * (a - 1), r.sum()])
        hess = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, grad)
        a, b = min(5.0, max(0.2, a - da)), b - db
    model.scale, model.shift = float(a), float(b)


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float | None:
    """The middle of the gap below which F1 falls; None where there are under 5 of either label."""
    if (toxic == 1).sum() < 5 or (toxic == 0).sum() < 5:
        return None
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], toxic[order]
    hits, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (n + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # rows of equal scores go together
    i = int(np.argmax(f1))
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


class Classifier:
    def __init__(self, model: Model, common: float, by_language: dict[str, float]):
        self.model, self.common, self.by_language = model, common, by_language


def labelled_rows(docs: DataFrame, labels: DataFrame, keep: Column | None, max_per_label: int, max_train_bytes: int) -> DataFrame:
    """(_id, _text, _lang, _toxic): one row per chosen id, of no more than max_train_bytes of text together."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_lid")).agg(F.max("toxic").alias("_toxic"))
    rows = docs.select(F.col("doc_id").alias("_id"), text_of("text").alias("_text"), F.col("lang").cast("string").alias("_lang"), F.xxhash64("doc_id", F.lit(SEED)).alias("_h"))
    rows = rows.where(keep) if keep is not None else rows
    ids = known.join(rows.select("_id", "_h").distinct(), F.col("_lid") == F.col("_id")).select("_lid", "_h", "_toxic")
    bounds = []
    for label in (0, 1):
        cut = ids.where(F.col("_toxic") == label).orderBy("_h", "_lid").limit(max_per_label)
        bounds.append(cut)
    chosen = F.broadcast(bounds[0].unionByName(bounds[1]).select("_lid", "_toxic"))  # 2 x max_per_label ids at most
    sized = rows.join(chosen, F.col("_id") == F.col("_lid")).withColumn("_size", F.octet_length(F.encode("_text", "UTF-8")).cast("long"))
    # One row of an id: the least (size, hash of the text, language).
    least = F.min(F.struct("_size", F.xxhash64("_text").alias("_x"), F.coalesce("_lang", F.lit("")).alias("_l"))).alias("_s")
    one = settle(sized.groupBy("_lid").agg(least, F.first("_toxic").alias("_toxic")).select("_lid", "_toxic", "_s.*", F.xxhash64("_lid", F.lit(SEED + 1)).alias("_turn")))
    left, last = max_train_bytes, None
    for r in sorted(one.select("_turn", "_size").collect()):  # 2 x max_per_label pairs of numbers at most
        left -= r["_size"]
        if left < 0:
            break
        last = r["_turn"]
    within = one.where(F.lit(False) if last is None else F.col("_turn") <= last)
    met = rows.join(F.broadcast(within), (F.col("_id") == F.col("_lid")) & (F.xxhash64("_text") == F.col("_x")) & (F.coalesce("_lang", F.lit("")) == F.col("_l")))
    return met.groupBy("_id").agg(F.first("_text").alias("_text"), F.first("_lang").alias("_lang"), F.first("_toxic").alias("_toxic"))


def fit(docs: DataFrame, labels: DataFrame, *, keep: Column | None = None, max_per_label: int = MAX_PER_LABEL, max_train_bytes: int = MAX_TRAIN_BYTES) -> Classifier:
    """Train, scale and find thresholds. ``keep``: which documents may be learnt from, over columns _id and _text."""
    found = labelled_rows(docs, labels, keep, max_per_label, max_train_bytes).toLocalIterator()  # a partition at a time: 2 x max_per_label rows and max_train_bytes in all, at most
    rows = [(zlib.crc32(str(r["_id"]).encode()), str(r["_id"]), r["_text"].encode("utf-8", "surrogatepass"), r["_lang"], r["_toxic"]) for r in found]
    rows = [r[2:] for r in sorted(rows, key=lambda r: r[:2])]
    toxic = np.array([r[2] for r in rows], np.float32)
    held = np.arange(len(rows)) % 5 == 4
    model = train([r[0] for r, h in zip(rows, held, strict=True) if not h], toxic[~held])
    if not model.trained:
        return Classifier(model, 1.0, {})
    texts, y = [r[0] for r, h in zip(rows, held, strict=True) if h], toxic[held]
    raw = np.concatenate([model.logits(*hash_in_parts(texts[i : i + 200])) for i in range(0, len(texts), 200)]) if texts else np.zeros(0)
    calibrate(model, raw, y)
    s = model.scores(texts)
    languages = np.array([r[1] or "" for r, h in zip(rows, held, strict=True) if h])
    common = best_threshold(s, y)
    found = {lang: best_threshold(s[languages == lang], y[languages == lang]) for lang in sorted({*languages} - {""})}
    return Classifier(model, 0.3 if common is None else common, {k: v for k, v in found.items() if v is not None})


def score_texts(docs: DataFrame, classifier: Classifier, *, text_col: str = "text") -> DataFrame:
    """All of ``docs`` with _score."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier.model)  # BUCKETS x DIM floats: 6 MB

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts]))

    return docs.withColumn("_score", score(F.col(text_col).cast("string")))


def threshold_of(lang: Column, classifier: Classifier) -> Column:
    out = F.lit(classifier.common)
    for k, v in classifier.by_language.items():
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    classifier = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), keep=fold(F.col("_id")) != 2)
    out = score_texts(docs, classifier)
    limit = threshold_of(F.col("lang"), classifier)
    return out.select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"),
        limit.alias("lang_threshold"), (F.col("_score") >= limit).cast("int").alias("rejected"),
    )
