"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's words (A-Z lower-cased) and the first four to eight bytes of each longer word, hashed into a fixed number of
slots. A slot is kept if its share among toxic and among clean training texts differs clearly, or if it is a word that
takes part in a telling pair: one whose two words stand together in another share of the toxic texts that hold the first than of the
clean ones. Over these the machine learns a weight each and, through a short vector each, a weight for every
pair: an insult beside a mention of a group may count for more than the two apart, though neither tells anything alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .mixing import uniform
from .tokens import ALNUM, Hasher, chunks, words

#: Labelled texts that a model is fitted on, at most (give or take the hash's luck); which ones their doc_ids' hash decides.
MAX_TRAIN = 20_000
SLOTS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
_SHIFT = np.uint64(64 - (SLOTS.bit_length() - 1))
FACTORS = 8
#: Standard errors by which a kept slot's share differs between toxic and clean texts, and the texts that must hold it.
MIN_Z, MIN_TEXTS = 4.0, 5
#: Words, the most widespread of the training texts, whose pairs are all tested, and the log likelihood ratio (twice) that a telling pair has.
PAIR_WORDS, MIN_RATIO = 2048, 36.0
FOLDS = 5
#: Gradient steps of a fit, at least.
STEPS = 3_000


@dataclass
class Machine:
    """slot: place of each kept slot among weights, or -1; bias; weights; vectors."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """The log odds of n texts, given the distinct (text, feature) pairs in order of text."""
        sums = np.zeros((n, self.vectors.shape[1]))
        np.add.at(sums, text, self.vectors[feature])
        squares = np.bincount(text, (self.vectors[feature] ** 2).sum(1), n)
        return self.bias + np.bincount(text, self.weights[feature], n) + 0.5 * ((sums**2).sum(1) - squares)


def terms(column: pa.Array, slot: np.ndarray | None = None, hasher: Hasher | None = None, sizes: tuple[int, ...] = (0, *PREFIXES)):
    """(first row, rows, text, slot) per chunk: the distinct slots of each text in order of text; with `slot`, kept ones, by their place.

    sizes are the bytes of the word beginnings to take, 0 for whole words.
    """
    hasher = hasher or Hasher(lower=True)
    for lo, hi, data, offsets in chunks(column):
        starts, ends, per = words(data, offsets, ALNUM)
        text = np.repeat(np.arange(hi - lo), np.diff(per))
        pairs = []
        for salt, size in enumerate(sizes):
            long_ = np.flatnonzero(ends - starts >= size)
            stop = starts[long_] + size if size else ends[long_]
            found = ((hasher(data, starts[long_], stop) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> _SHIFT).astype(np.int64)
            of = text[long_]
            if slot is not None:
                found = slot[found]
                of, found = of[found >= 0], found[found >= 0]
            pairs.append(of * SLOTS + found)
        pairs = np.unique(np.concatenate(pairs))
        yield lo, hi - lo, pairs // SLOTS, pairs % SLOTS


def fit(text: np.ndarray, feature: np.ndarray, label: np.ndarray, n_features: int, epochs: int | None = None, batch: int = 64, rate: float = 0.1, decay: float = 1e-3, seed: int = 1):
    """(bias, weights, vectors) by adaptive gradient steps on the logistic loss of texts with these distinct features.

    Without a number of epochs there are STEPS steps or 10 epochs, whichever is more.
    """
    rng = np.random.default_rng(seed)
    n = len(label)
    epochs = epochs or max(10, -(-STEPS * batch // max(1, n)))
    prior = (label.sum() + 0.5) / (n + 2)  # without labels, below one half
    bias = float(np.log(prior / (1 - prior)))
    weights, vectors = np.zeros(n_features), rng.normal(0, 0.01, (n_features, FACTORS))
    seen_w, seen_v = np.full(n_features, 1e-8), np.full((n_features, FACTORS), 1e-8)
    cut = np.searchsorted(text, np.arange(n + 1))
    for _ in range(epochs if n_features else 0):
        order = rng.permutation(n)
        for b in range(0, n, batch):
            ids = order[b : b + batch]
            size = cut[ids + 1] - cut[ids]
            of = np.repeat(np.arange(len(ids)), size)
            f = feature[np.repeat(cut[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            own = vectors[f]
            sums = np.zeros((len(ids), FACTORS))
            np.add.at(sums, of, own)
            odds = bias + np.bincount(of, weights[f], len(ids)) + 0.5 * ((sums**2).sum(1) - np.bincount(of, (own**2).sum(1), len(ids)))
            slope = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label[ids]
            bias -= rate * float(slope.mean())
            used, at = np.unique(f, return_inverse=True)
            share = slope[of] / len(ids)
            g = np.bincount(at, share, len(used)) + decay * weights[used]
            seen_w[used] += g**2
            weights[used] -= rate * g / np.sqrt(seen_w[used])
            g = decay * vectors[used]
            np.add.at(g, at, share[:, None] * (sums[of] - own))
            seen_v[used] += g**2
            vectors[used] -= 0.3 * rate * g / np.sqrt(seen_v[used])
    return bias, weights, vectors


def telling_words(text: np.ndarray, word: np.ndarray, label: np.ndarray, n_words: int) -> np.ndarray:
    """Which of the words take part in a telling pair, from the distinct (text, word) pairs of texts with these labels.

    Of the toxic and of the clean texts that hold a word, the shares that hold another are compared by their likelihood
    ratio; pairs that fewer than MIN_TEXTS texts hold tell nothing. All pairs of words are counted.
    """
    both = np.zeros((2, n_words, n_words), np.float32)
    step = max(1, (1 << 22) // max(1, n_words))
    for lo in range(0, len(label), step):
        part = slice(*np.searchsorted(text, (lo, lo + step)))
        held = np.zeros((min(step, len(label) - lo), n_words), np.float32)
        held[text[part] - lo, word[part]] = 1
        for k in (0, 1):
            some = held[label[lo : lo + step] == k]
            both[k] += some.T @ some
    alone = np.stack([np.diagonal(both[k]) for k in (0, 1)]).astype(np.float64)
    telling = np.zeros(n_words, bool)
    entropy = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for lo in range(0, n_words, 256):
        n, hit = alone[:, lo : lo + 256, None], both[:, lo : lo + 256].astype(np.float64)
        miss, (total, hits) = n - hit, (n.sum(0), hit.sum(0))
        ratio = 2 * ((entropy(hit) + entropy(miss) - entropy(n)).sum(0) - entropy(hits) - entropy(total - hits) + entropy(total))
        first, second = np.nonzero((ratio >= MIN_RATIO) & (hits >= MIN_TEXTS))
        telling[lo + first] = telling[second] = True
    return telling


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 5) -> Machine:
    """A machine fitted on at most about max_train of the texts that labels(doc_id, toxic) marks.

    Rows without a label or doc_id are left out; of several labels of a doc_id the largest holds, of several texts that of
    the smallest hash, so the result does not depend on the order of rows. Null and empty texts have no terms. Pairs are
    sought among the PAIR_WORDS words that most training texts hold; a pair of rarer words stands in too few of them to be
    learnt. The driver receives a count per slot (at most SLOTS) and the kept slots of the sampled texts. No label, or labels of one
    kind: no slot is kept, and the bias is the base rate.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_train / max(1, known.count()))
    sample = known.where(uniform(F.col("doc_id"), seed) < share)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("t"), F.max("toxic").alias("toxic"))
    texts = written(texts.select("doc_id", F.col("t.text").alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")

    def count(batches):
        held = np.zeros((3, SLOTS), np.int64)
        for batch in batches:
            label = np.asarray(batch.column("toxic"))
            for lo, n, text, found in terms(batch.column("text")):
                for k in (0, 1):
                    held[k] += np.bincount(found[label[lo + text] == k], minlength=SLOTS)
            for _, _, _, found in terms(batch.column("text"), sizes=(0,)):
                held[2] += np.bincount(found, minlength=SLOTS)
        some = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *held[:, some])], ["slot", "clean", "toxic", "words"])

    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    slot, alone, pairable = np.full(SLOTS, -1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if clean and toxic:
        found = texts.mapInArrow(count, "slot long, clean long, toxic long, words long").groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "words")]).toPandas().sort_values("slot")
        p = (found["clean"] + found["toxic"]) / (clean + toxic)
        z = (found["toxic"] / toxic - found["clean"] / clean) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / toxic + 1 / clean))
        alone = found["slot"][(z.abs() >= MIN_Z) & (found["clean"] + found["toxic"] >= MIN_TEXTS)].to_numpy()
        words_ = found[(found["words"] >= MIN_TEXTS) & ~found["slot"].isin(alone)].sort_values(["words", "slot"], ascending=[False, True])
        pairable = words_["slot"].to_numpy()[:PAIR_WORDS]
        slot[alone], slot[pairable] = np.arange(len(alone)), len(alone) + np.arange(len(pairable))

    def gather(batches):
        for batch in batches:
            for lo, n, text, found in terms(batch.column("text"), slot):
                cut = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("toxic").slice(lo, n), pa.ListArray.from_arrays(cut, pa.array(found.astype(np.int32)))], ["doc_id", "toxic", "found"])

    rows = texts.mapInArrow(gather, f"doc_id {dict(texts.dtypes)['doc_id']}, toxic int, found array<int>").toArrow().sort_by("doc_id").combine_chunks()
    held = rows.column("found").combine_chunks()
    sizes, feature = np.asarray(held.value_lengths()).astype(np.int64), np.asarray(held.flatten()).astype(np.int64)
    label, text = np.asarray(rows.column("toxic")).astype(np.float64), np.repeat(np.arange(rows.num_rows), sizes)
    word = feature >= len(alone)
    telling = np.flatnonzero(telling_words(text[word], feature[word] - len(alone), label, len(pairable)))
    slot[pairable] = -1
    slot[pairable[telling]] = len(alone) + np.arange(len(telling))
    place = np.full(len(alone) + len(pairable), -1, np.int64)
    place[: len(alone)], place[len(alone) + telling] = np.arange(len(alone)), len(alone) + np.arange(len(telling))
    keep = place[feature] >= 0
    return Machine(slot, *fit(text[keep], place[feature[keep]], label, len(alone) + len(telling)))


def _scores(column: pa.Array, machine: Machine, hasher: Hasher) -> np.ndarray:
    out = np.zeros(len(column))
    for lo, n, text, found in terms(column, machine.slot, hasher):
        out[lo : lo + n] = machine.raw(text, found, n)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1, of the whole text), predicted (1 if score >= 0.5). A null text is empty and has the bias's score."""

    def run(batches):
        hasher = Hasher(lower=True)
        for batch in batches:
            score = _scores(batch.column(1), machine, hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def fold(doc_id):
    """crc32 of the doc_id's digits modulo FOLDS; null counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))


def toxicity_report(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Labels of held-out rows (fold 0) are never read.

    Repeated rows: each scored, alike. Empty docs: no rows. No labels, or of one kind: every score is the labels' smoothed base
    rate. Only text enters a score. Other columns are ignored.
    """
    machine = train(docs, labels.where(fold(F.col("doc_id")) != 0), max_train)
    return scored(docs, machine).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def nontoxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores `threshold` or more; all columns are kept, whatever their names.

    A null or empty text has the bias's score; repeated rows fall alike; nulls elsewhere do not matter; empty docs: no rows.
    """
    at = docs.columns.index("text")

    def run(batches):
        hasher = Hasher(lower=True)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), machine, hasher) < threshold))

    return docs.mapInArrow(run, docs.schema)
