"""Toxic spans by a linear-chain conditional random field; its token marginals add up to a document score."""
from __future__ import annotations

import math
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import map_columns, small_batches, table

FOLDS, HELD_OUT = 5, 0
TOXIC_ROWS, CLEAN_ROWS = 2000, 3000  # bound of the labelled sample that is learned from
TABLE = 1 << 18
PREFIXES = range(4, 10)
SURE = 1.0  # lower bound of the log odds from which a token of a toxic document is taken as toxic
LONGEST = 128  # tokens of a sequence; a longer sentence goes on in the next one
EPOCHS, BATCH, RATE, DECAY = 6, 2048, 0.3, 1e-4
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
ASCII = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(ASCII)


def features(word: str) -> list[int]:
    """Places of a word and its prefixes in the weight table."""
    parts = [f"w:{word}", *(f"{k}:{word[:k]}" for k in PREFIXES if k <= len(word))]
    return [zlib.crc32(p.encode()) % TABLE for p in parts]


class Emissions(dict):
    """Score for toxic against clean of each word met; NaN for the end of a sentence. Emptied when it grows past a fixed size."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        if len(self) >= 500_000:
            self.clear()
        v = self[word] = math.nan if word in ENDS else self.bias + float(self.weights[features(word)].sum())
        return v


def sequences(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token places without the ends, and start and length of each sequence among them."""
    keep = np.flatnonzero(~ends)
    if not len(keep):
        return keep, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sentence = np.cumsum(ends)[keep]
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    within = np.arange(len(keep)) - np.repeat(first, np.diff(np.r_[first, len(keep)]))
    start = np.flatnonzero(within % LONGEST == 0)
    return keep, start, np.diff(np.r_[start, len(keep)])


def forward_backward(x: np.ndarray, n: np.ndarray, trans: np.ndarray, begin: float):
    """Marginals of the toxic state, and pair marginals per step, for padded odds ``x`` with row lengths ``n``.

    ``trans`` holds the potentials from state to state, ``begin`` that of a toxic first token.
    """
    rows, width = x.shape
    a = np.empty((width, 2, rows))
    b = np.ones((width, 2, rows))
    a[0, 1], a[0, 0] = begin * x[:, 0], 1.0
    a[0] /= a[0].sum(axis=0)
    for t in range(1, width):
        a[t, 1] = (a[t - 1, 0] * trans[0, 1] + a[t - 1, 1] * trans[1, 1]) * x[:, t]
        a[t, 0] = a[t - 1, 0] * trans[0, 0] + a[t - 1, 1] * trans[1, 0]
        a[t] /= a[t].sum(axis=0)
    for t in range(width - 2, -1, -1):
        toxic = x[:, t + 1] * b[t + 1, 1]
        for i in (0, 1):
            b[t, i] = trans[i, 0] * b[t + 1, 0] + trans[i, 1] * toxic
        b[t] /= b[t].sum(axis=0)
        b[t][:, n <= t + 1] = 1.0
    p = a[:, 1] * b[:, 1] / (a * b).sum(axis=1)
    return p.T, a, b


def _buckets(length: np.ndarray):
    """Sequences of about equal length, by row numbers, with the width that holds them."""
    low, width = 0, 4
    while low < LONGEST:
        pick = np.flatnonzero((length > low) & (length <= width))
        for i in range(0, len(pick), 4096):
            yield pick[i : i + 4096], int(length[pick[i : i + 4096]].max())
        low, width = width, width * 2


def marginals(e: np.ndarray, trans: np.ndarray, begin: float) -> np.ndarray:
    """Probability of the toxic state for each token of a run of scores; 0 at sentence ends."""
    out = np.zeros(len(e))
    keep, start, length = sequences(np.isnan(e))
    x = np.exp(np.clip(e[keep], -30, 30))
    for rows, width in _buckets(length):
        at = start[rows][:, None] + np.arange(width)
        inside = np.arange(width) < length[rows][:, None]
        at = np.where(inside, at, 0)
        p, _, _ = forward_backward(x[at], length[rows], trans, begin)
        out[keep[at[inside]]] = p[inside]
    return out


class Model:
    """Weights of the field and of the document score."""

    def __init__(self):
        self.weights, self.bias = np.zeros(TABLE, np.float32), -4.0
        self.log_trans, self.log_begin = np.zeros((2, 2)), 0.0
        self.doc = np.array([-9.0, 0.0, 0.0, 0.0])

    def tagger(self) -> Emissions:
        return Emissions(self.weights, self.bias)

    def tag(self, texts: list[str], scores: Emissions) -> tuple[np.ndarray, list[np.ndarray]]:
        """Document features (total, greatest and share of the marginals, logs taken where they spread) and the marginals."""
        tokens = [TOKEN.findall(lowered(t)) for t in texts]
        lengths = [len(x) + 1 for x in tokens]
        e = np.full(sum(lengths), np.nan)
        at = 0
        for words, n in zip(tokens, lengths):  # the last place stays an end
            e[at : at + n - 1] = np.fromiter(map(scores.__getitem__, words), np.float64, n - 1)
            at += n
        p = np.split(marginals(e, np.exp(self.log_trans), math.exp(self.log_begin)), np.cumsum(lengths)[:-1])
        doc = np.array([(q.sum(), q.max(), n) for q, n in zip(p, lengths)]).reshape(-1, 3)
        return np.c_[np.ones(len(doc)), np.log1p(doc[:, 0]), doc[:, 1], np.sqrt(doc[:, 0] / (doc[:, 2] + 20))], p

    def score(self, doc: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(doc @ self.doc, -40, 40)))


def distinct_texts(texts: list[str]) -> list[int]:
    """Rows without the near copies of an earlier one: none of three minimum hashes over five-word shingles was met before."""
    seen: set = set()
    out = []
    for i, t in enumerate(texts):
        words = t.encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 5])) for j in range(max(1, len(words) - 4))]
        keys = {(k, min(h * m & 0xFFFFFFFFFFFFFFFF for h in hashes)) for k, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def learn(rows: list[tuple[str, int]], toxic_share: float) -> Model | None:
    """Fit on labelled texts: two thirds teach the field, the rest the document score. None unless both classes occur in both parts."""
    rows = [rows[i] for i in distinct_texts([t for t, _ in rows])]
    part = [[r for i, r in enumerate(rows) if (i % 3 == 2) == last] for last in (False, True)]
    if any(len({y for _, y in p}) < 2 for p in part):
        return None
    model = Model()
    tokens = [TOKEN.findall(lowered(t)) for t, _ in part[0]]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in tokens for w in x))}
    lists = [[] if w in ENDS else features(w) for w in vocabulary]
    ids = np.array([x + [TABLE] * (len(PREFIXES) + 1 - len(x)) for x in lists], np.int64)
    count = np.zeros((2, TABLE + 1))
    for x, (_, y) in zip(tokens, part[0]):
        held = np.unique(ids[[vocabulary[w] for w in set(x)]]) if x else np.zeros(0, np.int64)
        count[y, held] += 1
    n_toxic = sum(y for _, y in part[0])
    a, b = count[1] + 0.5, count[0] + 0.5
    surely = np.log(a / (n_toxic + 1)) - np.log(b / (len(tokens) - n_toxic + 1)) - 1.64 * np.sqrt(1 / a + 1 / b)
    surely[TABLE] = -9
    of_word = surely[ids].max(axis=1) >= SURE
    word = np.concatenate([np.r_[[vocabulary[w] for w in x], -1].astype(np.int64) for x in tokens])
    truth = np.repeat([y for _, y in part[0]], [len(x) + 1 for x in tokens]).astype(bool) & of_word[word]
    is_end = np.array([w in ENDS for w in vocabulary])[word] | (word < 0)
    keep, start, length = sequences(is_end)
    word, truth = word[keep], truth[keep]
    weights, square = np.zeros(TABLE + 1), np.full(TABLE + 1, 1e-8)
    small, small_square = np.array([model.bias, 0, 0, 0, 0.0]), np.full(5, 1e-8)  # bias, begin, 0-1, 1-0, 1-1
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(len(start))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            grad, small_grad, n = np.zeros(TABLE + 1), np.zeros(5), len(pick)
            trans = np.exp([[0, small[2]], [small[3], small[4]]])
            for rows_, width in _buckets(length[pick]):
                s, k = start[pick][rows_], length[pick][rows_]
                inside = np.arange(width) < k[:, None]
                at = np.where(inside, s[:, None] + np.arange(width), 0)
                feats = ids[word[at]]
                x = np.exp(np.clip(small[0] + weights[feats].sum(axis=2), -30, 30))
                p, fa, fb = forward_backward(x, k, trans, math.exp(small[1]))
                y = truth[at]
                d = np.where(inside, p - y, 0.0)
                grad += np.bincount(feats.ravel(), np.repeat(d.ravel(), feats.shape[2]), TABLE + 1)
                small_grad[0] += d.sum()
                small_grad[1] += d[:, 0].sum()
                for t in range(width - 1):
                    live = k > t + 1
                    pair = np.array([[fa[t, u] * trans[u, v] * (x[:, t + 1] if v else 1) * fb[t + 1, v] for v in (0, 1)] for u in (0, 1)])
                    pair = (pair / pair.sum(axis=(0, 1)))[:, :, live].sum(axis=2)
                    for j, (u, v) in enumerate(((0, 1), (1, 0), (1, 1))):
                        small_grad[2 + j] += pair[u, v] - ((y[live, t] == u) & (y[live, t + 1] == v)).sum()
            grad, small_grad = grad / n + DECAY * weights, small_grad / n
            grad[TABLE] = 0
            square += grad * grad
            small_square += small_grad * small_grad
            weights -= RATE * grad / np.sqrt(square)
            small -= RATE * small_grad / np.sqrt(small_square)
    weights[np.abs(weights) < 1e-3] = 0
    model.weights, model.bias, model.log_begin = weights[:TABLE].astype(np.float32), float(small[0]), float(small[1])
    model.log_trans = np.array([[0, small[2]], [small[3], small[4]]])
    doc, _ = model.tag([t for t, _ in part[1]], model.tagger())
    y = np.array([y for _, y in part[1]])
    share = y.mean()
    weight = np.where(y == 1, toxic_share / share, (1 - toxic_share) / (1 - share))
    beta = np.zeros(doc.shape[1])
    for _ in range(50):  # Newton steps of a weighted logistic regression
        p = 1 / (1 + np.exp(-np.clip(doc @ beta, -30, 30)))
        g = doc.T @ (weight * (p - y)) + 0.01 * len(y) ** 0.5 * beta * [0, 1, 1, 1] / 10
        h = (doc * (weight * p * (1 - p))[:, None]).T @ doc + np.diag([1e-6, 0.05, 0.05, 0.05])
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    model.doc = beta
    return model


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """Learn from at most ``toxic_rows`` and ``clean_rows`` different labelled texts outside the held-out fold, first by text hash."""
    told = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.where("text IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", F.xxhash64("text").alias("h")).join(told, "doc_id")
    known = known.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return None
    picks = [known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    chosen = picks[0].union(picks[1])
    rows = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).select("h", "text", "toxic").collect()
    unique = sorted({(r["h"], r["text"], r["toxic"]) for r in rows})
    return learn([(t, y) for _, t, y in unique], total[1] / (total[0] + total[1]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, n_spans, spans): the score and the toxic spans as character offsets with their mean marginal.

    Neighbouring tokens of a sentence with marginals of one half or more are one span. Only the text is read: equal texts have equal
    scores. NULL and empty texts have no tokens and the score of a text without toxic tokens; without a model every score is 0.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[list]:
        m, out = held.value, ([], [])
        if m is None:
            return [[0.0] * len(texts), [[] for _ in texts]]
        if not hasattr(m, "cache"):
            m.cache = m.tagger()
        for i in range(0, len(texts), 64):
            some = [t or "" for t in texts[i : i + 64]]
            doc, p = m.tag(some, m.cache)
            out[0].extend(m.score(doc).tolist())
            for t, q in zip(some, p):
                spans: list[dict] = []
                if (q >= 0.5).any():
                    last = -2
                    for j, found in enumerate(TOKEN.finditer(lowered(t))):
                        if q[j] >= 0.5:
                            if last == j - 1:
                                spans[-1]["end"], spans[-1]["p"], spans[-1]["n"] = found.end(), spans[-1]["p"] + q[j], spans[-1]["n"] + 1
                            else:
                                spans.append({"start": found.start(), "end": found.end(), "p": q[j], "n": 1})
                            last = j
                out[1].append([{"start": s["start"], "end": s["end"], "p": float(s["p"] / s["n"])} for s in spans])
        return list(out)

    return map_columns(docs.select("doc_id", "text"), ["text"], "score double, spans array<struct<start:int,end:int,p:double>>", run)


def op9_field_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
