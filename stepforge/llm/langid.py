"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's vector is the mean of the embeddings of its hashed subwords (runs of 1 to 4 bytes of lower-cased words, with
their edges). Embeddings and the softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows. Temperature and rejection thresholds come from labelled rows that training did not see: a text
is rejected if its score is near chance, or if too few of its longer subwords are known from training.

For prediction the model folds into one table of logits (and what is known) by bucket, so a text costs one lookup a
subword.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release
from .kernels import slices

BUCKETS, WIDTH, SIZES = 1 << 16, 16, (1, 2, 3, 4)
EPOCHS, RATE = 3, 0.5
#: Subwords of so many bytes tell whether a text is like those of training; shorter ones are met in any language.
FAMILIAR_SIZE = 3
#: Labelled rows that training and calibration may take, overall and of each language.
SAMPLE_ROWS, SAMPLE_OF_LANGUAGE = 4000, 800
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
FACTORS = np.asarray([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray):
    """(bucket, text number) arrays for each size, over lower-cased UTF-8 bytes. Bytes other than letters are edges."""
    letter = LETTER[data]
    clean = np.where(letter, data, 32).astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        whole = owner[:n] == owner[size - 1 :]
        for k in range(1, size - 1):  # an edge may come first or last only
            whole &= letter[k : k + n]
        whole &= letter[:n] | letter[size - 1 :] if size > 1 else letter[:n]
        code = np.full(n, size, np.uint32)
        for k in range(size):
            code = (code ^ clean[k : k + n]) * FACTORS[k]
            code ^= code >> np.uint32(15)
        at = np.flatnonzero(whole)
        yield (code[at] & np.uint32(BUCKETS - 1)).astype(np.int64), owner[at]


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    known: np.ndarray  # buckets of the subwords of FAMILIAR_SIZE or more that training met
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: float = 0.0  # least share of known subwords

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, a row for each text, and the share of its longer subwords that are known (1 if it has none)."""
        n = len(offsets) - 1
        total, counts, longer, known = np.zeros((n, len(self.languages))), np.zeros(n), np.zeros(n), np.zeros(n)
        for size, (bucket, owner) in zip(SIZES, subwords(data, offsets), strict=False):
            times = np.bincount(owner, minlength=n)
            counts += times
            if size >= FAMILIAR_SIZE:
                longer += times
                known += np.bincount(owner[self.known[bucket]], minlength=n)
            found = self.logits[bucket]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, weights=found[:, k], minlength=n)
        z = (total / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), np.where(longer > 0, known / np.maximum(longer, 1), 1.0)


def lower_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    _, _, data, offsets = next(slices(pc.utf8_lower(pa.array(texts, pa.large_string())), 1 << 62))
    return data, offsets


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fits a model; every fifth text is held back for calibration. Each text counts whole and as two short pieces."""
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = {x: k for k, x in enumerate(languages)}
    fit: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        pieces = [text]
        for _ in range(2):
            size = int(random.integers(15, 200))
            at = int(random.integers(0, max(1, len(text) - size)))
            pieces.append(text[at : at + size])
        (held if k % 5 == 4 else fit).extend((p, target[label]) for p in pieces if p)

    embedding = (random.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    weights, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    known = np.zeros(BUCKETS, bool)
    for text, _ in fit:
        for size, (bucket, _) in zip(SIZES, subwords(*lower_bytes([text])), strict=False):
            if size >= FAMILIAR_SIZE:
                known[bucket] = True

    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text and their shares; built again each time, which takes less memory than keeping them."""
        buckets = np.concatenate([b for b, _ in subwords(*lower_bytes([text]))] or [np.zeros(0, np.int64)])
        found, times = np.unique(buckets, return_counts=True)
        return found, (times / max(1, len(buckets))).astype(np.float32)

    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(fit)):
            found, share = features(fit[k][0])
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if not len(found):
                continue
            vector = share @ embedding[found]
            z = vector @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[fit[k][1]] -= 1
            back = weights @ p
            weights -= rate * np.outer(vector, p)
            bias -= rate * np.float32(0.01) * p
            embedding[found] -= (rate * len(found) ** np.float32(0.5)) * np.outer(share, back)

    model = Model(languages, (embedding @ weights).astype(np.float32), bias, known)
    if held:
        calibrate(model, [t for t, _ in held], np.asarray([y for _, y in held]))
    return model


def calibrate(model: Model, texts: list[str], truth: np.ndarray) -> None:
    """Temperature of least log loss and both thresholds, from texts that training did not see.

    The score's rejects at most one in a thousand right answers, and none above 1.5 times chance. The share's lies halfway
    between the share that unrelated subwords would reach (by collisions, the part of the buckets that are known) and the
    share that all but one in a thousand right answers reach.
    """

    def scored() -> tuple[np.ndarray, np.ndarray]:
        parts = [model.scores(*lower_bytes(texts[k : k + 100])) for k in range(0, len(texts), 100)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])

    base, share = scored()
    logs = np.log(np.maximum(base, 1e-30))

    def loss(temperature: float) -> float:
        z = logs / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    model.temperature = float(min(np.geomspace(0.02, 20, 121), key=loss))
    after = scored()[0]
    right = after.argmax(axis=1) == truth
    if right.any():
        model.threshold = float(min(0.5, 1.5 / len(model.languages), np.quantile(after.max(axis=1)[right], 0.001)))
        reached = float(np.quantile(share[right], 0.001))
        model.familiar = min(reached, (reached + float(model.known.mean())) / 2)


def fit(docs: DataFrame, of_language: int = SAMPLE_OF_LANGUAGE, rows: int = SAMPLE_ROWS) -> Model:
    """Trains on labelled rows of docs (doc_id, text, lang) whose crc32(doc_id) mod 5 is not 0.

    Rows are sampled by the hash of their doc_id at a rate for each language that makes its expected number
    ``of_language``, and ``rows`` at most come to the driver. Rows without text or language don't count. Without any
    row the model knows no language and answers ``und`` throughout.
    """
    usable = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and text <> ''").filter("crc32(cast(doc_id as string)) % 5 <> 0")
    per = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not per:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(BUCKETS, bool))
    rate = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, of_language / n))) for x, n in per.items()])
    place = F.xxhash64(F.lit("language sample"), F.col("doc_id"))
    chosen = usable.withColumn("place", place).filter(F.pmod("place", F.lit(1_000_000)) < rate * 1_000_000).orderBy("place", "text").limit(rows)
    sample = chosen.select("text", "lang").collect()
    model = train([r[0] for r in sample], [r[1] for r in sample])
    del sample
    release(docs.sparkSession)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names are replaced); only text decides.

    A null text or one without a letter is ``und`` with score 0. ``rejected``: und, a score below the model's threshold,
    or a share of known subwords below its other one. Whole texts count, however long.
    """
    columns = [f for f in docs.schema if f.name not in ("lang_pred", "score", "rejected")]
    names = [f.name for f in columns]
    text_at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(text_at)
            pred, score, rejected = [], [], []
            lowered = pc.utf8_lower(texts.cast(pa.large_string()))
            for a, _, data, offsets in slices(lowered):
                ascii_letters = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123))])[offsets]
                p, share = model.scores(data, offsets) if model.languages else (None, None)
                for k in range(len(offsets) - 1):
                    has = ascii_letters[k + 1] > ascii_letters[k] or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
                    best = int(p[k].argmax()) if p is not None and has else -1
                    pred.append(model.languages[best] if best >= 0 else UNKNOWN)
                    score.append(min(1.0, float(p[k][best])) if best >= 0 else 0.0)
                    rejected.append(best < 0 or score[-1] < model.threshold or bool(share[k] < model.familiar))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*columns, *extra]))
