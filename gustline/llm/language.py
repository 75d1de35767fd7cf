"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its character n-grams, hashed into a
table of fixed size; the language is a linear softmax of that mean.  Training
is stochastic gradient descent in numpy on a bounded sample of labelled texts.

Two measures are calibrated on texts kept from training.  A temperature makes
the softmax a probability.  A softmax shares all probability among the languages
it knows, so it can't tell a text of none of them; therefore the n-grams of a
text are also weighed by how much likelier they are in the language found than
by chance.  How far that mean may fall below what the language's own texts show,
for a text of so many n-grams, is learned from them; what falls further is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.rows import shield
from gustline.llm.staging import bound_batches
from gustline.llm.words import mix, parts, text_bytes

#: Rows of the embedding table, its width, and the n-gram lengths in bytes.
BUCKETS, WIDTH, LENGTHS = 1 << 13, 16, (1, 2, 3, 4)
#: Most labelled texts that a model is fitted on, in like parts for its languages, and the share of them that calibrates it.
SAMPLE_ROWS, CALIBRATION = 4000, 0.2
#: Most languages (the commonest are learned), and labelled texts that each has at least if there are as many.
MOST_LANGUAGES, LEAST_ROWS = 400, 50
#: Passes over the sample, more where it is small, so that there are LEAST_STEPS.
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 600, 32, 2.0
#: Share of calibration texts below the point from which either bound is set, and by how much the fit's is let down.
REFUSED, SLACK = 0.002, 1.2
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_STEP = np.uint64(0x9E3779B97F4A7C55)


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the n-grams' buckets and documents.

    Bytes but letters count as blanks, runs of blanks as one, and A-Z as small letters.
    """
    folded = _FOLD[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    blank = folded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep |= first
    folded = folded[keep].astype(np.uint64)
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(kept))
    for n in LENGTHS:
        last = len(folded) - n + 1
        if last <= 0:
            continue
        value = np.full(last, np.uint64(n), np.uint64)
        for k in range(n):
            value = value * np.uint64(257) + folded[k : k + last]
        one = document[:last] == document[n - 1 :]
        yield (mix(value * _STEP)[one] >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64), document[:last][one]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its number of n-grams, the buckets it has, and their frequencies."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in parts(offsets, 1 << 18):
            own = offsets[a : b + 1] - offsets[a]
            pairs = np.concatenate([np.zeros(0, np.int64)] + [d * BUCKETS + k for k, d in _ngrams(data[offsets[a] : offsets[b]], own)])
            pairs, counts = np.unique(pairs, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(b - a + 1) * BUCKETS)
            cells = []
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
                n = int(counts[low:high].sum())
                share = (counts[low:high] / max(n, 1)).astype(np.float32)
                cells.append((n, (pairs[low:high] % BUCKETS).astype(np.uint16).tobytes(), share.tobytes()))
            n, buckets, shares = zip(*cells)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(a, b - a), pa.array(n, pa.int64()), pa.array(buckets), pa.array(shares)],
                ["lang", "n", "buckets", "shares"],
            )


@dataclass
class Bags:
    """Texts as sparse rows of bucket frequencies, and how many n-grams each has."""

    buckets: list[np.ndarray]
    shares: list[np.ndarray]
    n: np.ndarray

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows.tolist()):
            out[i, self.buckets[r]] = self.shares[r]
        return out


@dataclass
class Model:
    """What prediction needs.

    ``scores`` are per-bucket class scores (embedding times classifier), ``weights`` per language how much likelier a
    bucket is there than by chance (logarithm).  A text of n n-grams in language l is expected to have the mean weight
    ``usual[l]``, give or take the root of spread[0] + spread[1] / n.
    """

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    weights: np.ndarray
    usual: np.ndarray
    spread: tuple[float, float] = (1.0, 1.0)
    least_score: float = 0.0
    least_fit: float = -np.inf

    def fit_of(self, mean_weight: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How many deviations a text lies above what texts of its language usually have."""
        return (mean_weight - self.usual[best]) / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(n, 1))


def fit(texts: Bags, languages: list[str], seed: int = 7) -> Model:
    """A model from texts and their languages."""
    names = sorted(set(languages))
    target = np.searchsorted(names, languages)
    random = np.random.default_rng(seed)
    order = random.permutation(len(target))
    held = order[: int(len(order) * CALIBRATION)]
    train = np.sort(order[len(held) :])
    embedding = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    linear = random.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    hot = np.eye(len(names), dtype=np.float32)
    usage = np.full((len(names), BUCKETS), 1 / BUCKETS)
    for r in train.tolist():
        usage[target[r], texts.buckets[r]] += texts.shares[r]
    weights = np.log(usage / usage.sum(axis=1, keepdims=True) * BUCKETS)
    batches = max(1, -(-len(train) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        random.shuffle(train)
        for low in range(0, len(train), BATCH):
            rows = train[low : low + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            bags = texts.dense(rows)
            hidden = bags @ embedding
            error = (_softmax(hidden @ linear + bias) - hot[target[rows]]) / len(rows)
            used = np.flatnonzero(bags.any(axis=0))
            pull = bags[:, used].T @ (error @ linear.T)
            linear -= rate * (hidden.T @ error)
            bias -= rate * error.sum(axis=0)
            embedding[used] -= rate * 64 * pull
    model = Model(names, embedding @ linear, bias, 1.0, weights.astype(np.float32), np.zeros(len(names)))
    calibrate(model, texts, target, held if len(held) >= 20 else order)
    return model


def calibrate(model: Model, texts: Bags, target: np.ndarray, held: np.ndarray) -> None:
    """Sets temperature, usual weights, their spread and both bounds from labelled texts."""
    if not len(held):
        return
    logits = np.concatenate([texts.dense(held[i : i + BATCH]) @ model.scores for i in range(0, len(held), BATCH)]) + model.bias
    truth = target[held]
    # a text never counts as wholly certain, or no temperature would be low enough where all are told apart
    sure = (len(held) + 1) / (len(held) + 2)
    aims = np.full(logits.shape, (1 - sure) / max(1, logits.shape[1] - 1))
    aims[np.arange(len(held)), truth] = sure
    tries = np.geomspace(0.001, 100, 200)
    losses = [-(aims * np.log(_softmax(logits / x) + 1e-30)).sum(axis=1).mean() for x in tries]
    model.temperature = float(tries[int(np.argmin(losses))])
    top = _softmax(logits / model.temperature).max(axis=1)
    mean = np.array([(model.weights[t, texts.buckets[r]] * texts.shares[r]).sum() for r, t in zip(held.tolist(), truth)])
    n = np.maximum(texts.n[held], 1)
    trust = np.sqrt(n)
    for t in range(len(model.languages)):
        mine = truth == t
        model.usual[t] = np.average(mean[mine], weights=trust[mine]) if mine.any() else np.average(mean, weights=trust)
    off = (mean - model.usual[truth]) ** 2
    # squares of short and of long texts settle the two parts of the spread
    per_text = float(np.quantile(off * n, 0.5) / 0.455)
    model.spread = (max(1e-6, float(np.quantile(np.maximum(off - per_text / n, 0), 0.9) / 2.7)), max(1e-6, per_text))
    fits = model.fit_of(mean, n, truth)
    # the fewer texts there are, the less their worst says of others
    slack = SLACK * (1 + 20 / len(held))
    # half way down to what no knowledge gives; a text of a word or two is seldom sure
    model.least_score = float((np.quantile(top, REFUSED) + 1 / len(model.languages)) / 2)
    model.least_fit = min(-1.0, float(np.quantile(fits, REFUSED))) * slack


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """A model from ``text`` and ``lang`` of rows where both are there.

    The sample is drawn by hash for each of the MOST_LANGUAGES commonest languages: about twice its part of ``rows``
    passes, equal texts count once, and the first by hash stay; a language has LEAST_ROWS at least, if there are as
    many.  Texts are reduced in their tasks to the buckets they have, at most six bytes for each of BUCKETS, which
    bounds what reaches the driver; there they stay sparse.
    """
    known = labelled.filter("text is not null and lang is not null")
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not common:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, np.zeros((0, BUCKETS)), np.zeros(0))
    each = max(LEAST_ROWS, rows // len(common))
    shares = F.create_map(*[F.lit(x) for r in common for x in (r["lang"], min(1.0, 2 * each / r["count"]))])
    order = F.xxhash64("text", F.lit(seed))
    near = F.shiftrightunsigned(order, 32) < F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0)) * float(1 << 32)
    few = known.filter(near).select("text", "lang", order.alias("_order")).dropDuplicates(["_order", "lang"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_order"))
    sample = few.withColumn("_nth", nth).filter(F.col("_nth") <= each).select("lang", "text")
    got = sample.repartition(16).mapInArrow(_bags, "lang string, n long, buckets binary, shares binary")
    found = sorted((r.lang, r.n, bytes(r.buckets), bytes(r.shares)) for r in got.toLocalIterator())
    bags = Bags(
        [np.frombuffer(b, np.uint16) for _, _, b, _ in found],
        [np.frombuffer(x, np.float32) for _, _, _, x in found],
        np.array([n for _, n, _, _ in found]),
    )
    return fit(bags, [lang for lang, *_ in found], seed)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then lang_pred, score and rejected of every row of ``docs``.

    Only ``text`` decides.  A text that is null or has no letter is ``und`` with score 0 and is rejected; so is, under
    its best language, a text whose calibrated score or fit is below the model's least.  A model that has learned no
    language makes every text ``und``.  An empty table gives no rows; repeated rows are predicted alike.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)], "text", lettered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        table, flat = np.ascontiguousarray(model.scores.T), model.weights.ravel()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False)
            best, scores = np.full(len(batch), len(model.languages)), np.zeros(len(batch))
            fits = np.full(len(batch), -np.inf)
            for a, b in parts(offsets, 1 << 18) if model.languages else ():
                own = offsets[a : b + 1] - offsets[a]
                total, count = np.zeros((b - a, len(table))), np.zeros(b - a)
                grams = list(_ngrams(data[offsets[a] : offsets[b]], own))
                for bucket, document in grams:
                    count += np.bincount(document, minlength=b - a)
                    for c, column in enumerate(table):
                        total[:, c] += np.bincount(document, column[bucket], b - a)
                logits = total / np.maximum(count, 1)[:, None] + model.bias
                chance = _softmax(logits / model.temperature)
                best[a:b], scores[a:b] = chance.argmax(axis=1), chance.max(axis=1)
                weight = np.zeros(b - a)
                for bucket, document in grams:
                    weight += np.bincount(document, flat[best[a:b][document] * BUCKETS + bucket], b - a)
                fits[a:b] = model.fit_of(weight / np.maximum(count, 1), count, best[a:b])
            refused = ~lettered | (scores < model.least_score) | (fits < model.least_fit)
            best[~lettered], scores[~lettered] = len(model.languages), 0.0
            kept = [batch.column(f"_keep{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names[best].tolist(), pa.string()), pa.array(scores), pa.array(refused)],
                [*[f"_keep{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"],
            )

    kinds = dict(docs.dtypes)
    schema = "".join(f"_keep{i} {kinds[c]}, " for i, c in enumerate(keep))
    found = rows.mapInArrow(run, f"{schema}lang_pred string, score double, rejected boolean")
    return found.withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})


def held_out():
    """Rows kept from training: crc32 of doc_id, as text, is a multiple of five; so is a null doc_id."""
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return (digest % 5 == 0).alias("held_out")


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row, by a model of the rows that are not held out.

    Reads ``doc_id``, ``text`` and ``lang`` alone.  A null doc_id counts as held out, a null or empty text is ``und``
    and rejected, a row without a language teaches nothing, and repeated rows are rows of their own.  An empty table
    gives no rows; without a labelled text every text is ``und``.
    """
    marked = docs.select("doc_id", "text", "lang", held_out())
    model = train(marked.filter(~F.col("held_out")).select("text", "lang"), rows)
    return predict(marked, model, ["doc_id", "held_out"])


def recognised(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, with all their columns, whatever their names.

    Null and empty texts, those without letters and those that fit no learned language go; repeated rows stay or go
    alike, and an empty table gives no rows.
    """
    marked = docs.select("doc_id", "text", "lang", held_out())
    model = train(marked.filter(~F.col("held_out")).select("text", "lang"), rows)
    own, restore = shield(docs, "text")
    return predict(own, model, own.columns).filter(~F.col("rejected")).select(*restore)
