"""Toxicity by non-negative positive-unlabelled learning.

A numpy classifier over hashed words and their beginnings learns from confirmed toxic documents (positive) and all other
documents (unlabelled, labels unseen). With the class prior p, the risk of a linear score g is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]),   l(z) = log(1 + exp(-z)),

where the second term is the negatives' risk corrected for the positives among the unlabelled; a step
that would take it below zero climbs back instead. The prior is the toxic share of the labelled rows
of the training folds. Training takes at most MAX_POSITIVE and MAX_UNLABELLED distinct texts (the first by
hash of doc_id), whatever the input; scoring takes every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, byte_view, column, free_names, mapped, slices
from larkspur.llm.unigram import words_of

BITS = 20
DIM = 1 << BITS
LAST = DIM - 1
MAX_POSITIVE = 2500
MAX_UNLABELLED = 7500
EPOCHS = 30
#: A text of this score or more is rejected.
CUT = 0.3
#: A word is used if this share of the positives has it, and more often than the unlabelled by so many standard errors.
SHARE, SURE = 0.03, 8.0
#: Beginnings of words, in characters, that are features besides the words.
PREFIXES = (4, 5, 6)
#: Counts in a text from which a word or beginning is a further feature: in a long text one may stand by chance.
LEVELS = (1, 2, 3)
#: Characters that are cut from a word's ends before it is hashed.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
EDGES = b".,;:!?\"'()[]{}<>*&%#$@~|_-/\\"


def word_slots(word: bytes) -> list[tuple[int, ...]]:
    """For a word, without what stands at its edges, and each of its beginnings: the slots of the LEVELS, parts of one hash."""
    bare = word.strip(EDGES)
    if bare.isascii():
        heads = [bare[:n] for n in PREFIXES if len(bare) > n]
    else:
        text = bare.decode()
        heads = [text[:n].encode() for n in PREFIXES if len(text) > n]
    hashes = [xxhash.xxh64_intdigest(bare), *(xxhash.xxh64_intdigest(b"^" + h) for h in heads)]
    return [(h & LAST, h >> BITS & LAST, h >> 2 * BITS & LAST) for h in hashes]


class Features:
    """The slots of texts; all have the weight 1. Told which slots count, it gives only those."""

    def __init__(self, counting: np.ndarray | None = None):
        self.counting = None if counting is None else set(counting.tolist())
        self.most = 250_000 if self.counting is not None else 30_000  # words that are held; mostly without slots, or with all
        self.known: dict[bytes, tuple] = {}

    def _parts(self, word: bytes) -> tuple:
        own = self.known.get(word)
        if own is None:
            own = tuple(word_slots(word))
            if self.counting is not None:
                own = tuple(x for x in own if not self.counting.isdisjoint(x))
            self.known[word] = own
        return own

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, slot) of a large_binary array's texts, sorted, each pair once. A word's parts are looked up once for all texts."""
        buf, offsets = byte_view(texts)
        none = np.zeros(0, np.int64)
        if not len(buf):
            return none, none
        if len(self.known) > self.most:
            self.known.clear()
        runs, first = words_of(_LOWER[buf], offsets)
        parts = [self._parts(w) for w in runs.dictionary.to_pylist()]
        number: dict[tuple, int] = {}
        at = [number.setdefault(x, len(number)) for own in parts for x in own]
        if not at:
            return none, none
        counts = np.array([len(own) for own in parts])
        starts, codes = np.cumsum(counts) - counts, runs.indices.to_numpy()
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        telling = counts[codes] > 0
        codes, rows = codes[telling], rows[telling]
        n = counts[codes]
        ends = np.cumsum(n)
        own = np.array(at)[np.repeat(starts[codes] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        pairs, times = np.unique(np.repeat(rows, n) * len(number) + own, return_counts=True)
        slots = np.array(list(number), np.int64)  # a row per part, a column per level
        row, slot = [], []
        for n_level, level in enumerate(LEVELS):
            hit = pairs[times >= level]
            row.append(hit // len(number))
            slot.append(slots[hit % len(number), n_level])
        both = np.unique(np.concatenate(row) * DIM + np.concatenate(slot))
        row, slot = both // DIM, both % DIM
        if self.counting is not None:
            keep = np.isin(slot, np.fromiter(self.counting, np.int64, len(self.counting)))
            row, slot = row[keep], slot[keep]
        return row, slot


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """A sigmoid of bias + the weights of a text's slots, scaled so that its cut lies at 0.3."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def scores(self, row: np.ndarray, slot: np.ndarray, rows: int) -> np.ndarray:
        """Of texts 0 to rows - 1, whose slots are the pairs (row, slot)."""
        margin = np.bincount(row, self.weights[slot], rows) + self.bias
        return _sigmoid(self.scale * margin + self.shift)


def telling(own: np.ndarray, all_: np.ndarray, n_own: int, n_all: float, share: float = SHARE, sure: float = SURE) -> np.ndarray:
    """Which slots a share of the positives have, and more often than the unlabelled by `sure` standard errors; the rest stays at weight 0. own, all_: how many of each set have a slot."""
    a, u = own / n_own, (all_ + 1) / (n_all + 2)
    z = (a - u) / np.sqrt(u * (1 - u) * (1 / n_own + 1 / n_all))
    return (own >= 3) & (a >= share) & (z >= sure)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The corrected risk of a linear score over positive rows p and unlabelled rows u, and the step's gradient."""
    loss = lambda x: np.logaddexp(0, -x)
    zp, zu = p @ w, u @ w
    positive, negative = prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()
    g_pos = -prior * (_sigmoid(-zp) @ p) / len(p)
    g_neg = (_sigmoid(zu) @ u) / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
    return positive + max(0.0, negative), g_pos + g_neg if negative >= 0 else -g_neg


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, epochs: int = EPOCHS, batch: int = 512, rate: float = 0.05, decay: float = 1e-3, seed: int = 11) -> Model:
    """positive, unlabelled: each text's slots among the chosen ones."""
    if not positive or not unlabelled:
        return Model(np.zeros(DIM, np.float32), -3.0)
    place = np.full(DIM, -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(docs):
        out = np.zeros((len(docs), len(chosen) + 1), np.float32)
        out[:, -1] = 1.0
        for row, at in zip(out, docs, strict=True):
            row[place[at]] = 1.0
        return out

    xp, xu = matrix(positive), matrix(unlabelled)
    rng = np.random.default_rng(seed)
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    chunks = max(1, len(xu) // batch)
    for _ in range(epochs):
        us, ps = np.array_split(rng.permutation(len(xu)), chunks), np.array_split(rng.permutation(max(len(xp), chunks)) % len(xp), chunks)
        for u, p in zip((xu[i] for i in us), (xp[i] for i in ps), strict=True):
            grad = risk(w, p, u, prior)[1] + decay * np.append(w[:-1], 0.0)
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIM, np.float32)
    weights[chosen] = w[:-1]
    scale, shift = _scale(xp @ w, xu @ w)
    return Model(weights, float(w[-1]), scale, shift)


def _scale(mp: np.ndarray, mu: np.ndarray) -> tuple[float, float]:
    """The score 0.3 stands halfway from the bulk of the unlabelled (their lower half) to the positives' lower quarter above it."""
    bulk = float(np.median(mu))
    above = mp[mp > bulk + 1e-9]
    low = float(np.quantile(above, 0.1)) if len(above) else bulk + 1.0
    cut = (bulk + low) / 2
    scale = 3.0 / max(1e-6, low - cut)
    return scale, float(np.log(0.3 / 0.7)) - scale * cut


def held_out():
    """Rows that training never sees: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVE, others: int = MAX_UNLABELLED) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic) -> a model from at most so many distinct texts.

    The texts' slots are written to the shared folder; the driver gets, of each text, only slots that tell. Equal texts count once.
    """
    scratch = Scratch(docs.sparkSession)
    seen = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = seen.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id"), F.col("digest")]
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("digest")).filter(~held_out() & F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    toxic = seen.filter("toxic = 1").select("doc_id")
    pos = texts.join(toxic, "doc_id", "left_semi").distinct().orderBy(*order).limit(positives).select("digest", F.lit(1).alias("kind"))
    rest = texts.distinct().orderBy(*order).limit(others).select("digest", F.lit(0).alias("kind"))
    chosen = pos.union(rest).groupBy("digest").agg(F.max("kind").alias("kind"))  # at most positives + others rows
    rows = docs.select(F.xxhash64(F.col("text").cast("binary")).alias("digest"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "digest")
    rows = rows.groupBy("digest", "kind").agg(F.first("text").alias("text")).select("kind", "text")

    def run(batches):
        features = Features()
        for batch in batches:
            for part, own in slices(batch, most=1 << 20):  # here every word has slots
                row, slot = features(own)
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["kind", "slots"])

    sample = scratch.stage(rows.mapInArrow(run, "kind int, slots array<int>").filter(F.size("slots") > 0).dropDuplicates(["kind", "slots"]), "sample")
    sizes = {r.kind: r["count"] for r in sample.groupBy("kind").count().collect()}
    n_own, n_rest = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(min(max(share or 0.05, 0.005), 0.5))
    if not n_own or not n_rest:
        scratch.drop()
        return train([], [], np.zeros(0, np.int64), prior)
    # the unlabelled set holds positives as well, as a draw from the whole
    mixed = min(n_own, int(n_rest * (share or 0.0)))
    counts = sample.select("kind", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count_if(F.col("kind") == 1).alias("own"), F.count_if(F.col("kind") == 0).alias("rest")).filter(F.col("own") >= F.greatest(F.lit(3), F.lit(SHARE * n_own)))
    found = counts.toPandas().sort_values("slot")  # at most a document's slots / SHARE
    own = found["own"].to_numpy(float)
    tell = found["slot"].to_numpy(np.int64)[telling(own, found["rest"].to_numpy(float) + own * mixed / n_own, n_own, n_rest + mixed)]

    def reduced(batches):
        for batch in batches:
            lists = batch.column("slots")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            hit = np.isin(flat, tell)
            sums = np.concatenate([[0], np.cumsum(hit)])
            kept = flat[hit].astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array([kept[a:b].tobytes() for a, b in zip(sums[ends[:-1]].tolist(), sums[ends[1:]].tolist())], pa.binary())], ["kind", "slots"])

    sets: tuple[list, list] = ([], [])
    for kind, slots in sorted(tuple(r) for r in sample.mapInArrow(reduced, "kind int, slots binary").collect()):
        sets[kind].append(np.frombuffer(slots, "<u4"))
    scratch.drop()
    return train(sets[1], sets[0] + sets[1][:: max(1, n_own // max(1, mixed))][:mixed], tell, prior)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and each whole text's score; a null or empty text has the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers

    def run(batches):
        own = shared.value
        features = Features(np.flatnonzero(own.weights))
        for batch in batches:
            for rows, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.scores(*features(texts), len(rows)), pa.float64())], [*rows.schema.names, name])

    return mapped(docs, run, [T.StructField(name, T.DoubleType())])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text; more columns are left out), labels (doc_id, toxic) -> doc_id, held_out, score, predicted.

    Null and empty texts have the score of no words; a text of any length is read whole; repeated rows stay, equal texts get
    equal scores; a null doc_id is never held out and teaches nothing; of an id's labels the largest counts. Without
    toxic labels all scores are alike and low. No rows, no result rows.
    """
    out = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects (a score of CUT or more). All columns stay, whatever their names; else as toxicity."""
    (score,) = free_names(docs, "score")
    text = docs if docs.schema["text"].dataType == T.StringType() else docs.withColumn("text", F.col("text").cast("string"))
    return scored(text, fit(docs.select("doc_id", "text"), labels), score).filter(F.col(score) < CUT).select(*map(column, docs.columns))
