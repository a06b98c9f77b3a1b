"""Document scores by a causal self-attention model over subword ids, beside a word-count baseline."""
from __future__ import annotations

import base64
import copy
import math
import re
from collections import Counter
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import join_sized, map_columns, row_key, small_batches, spill, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: how texts are cut before this vocabulary's merges
FOLDS, HELD_OUT = 10, 0
COMMON_SHARE = 2e-6  # of all training tokens: at most 500,000 words can have it, so these are sent to all tasks
WIDE_SPACE, FILLER = re.compile(" [\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), "a"
COUNTED_CHARS = 8 << 20  # text that is counted at once
TRAIN_TEXTS = 1200  # texts that the weights start from; then all training texts teach them
LEARNED_CHARS = 2 << 20  # text whose windows are put in random order at once
WIDTH, BLOCK, CONTEXT = 16, 16, 16  # of vectors; tokens scored by a window; tokens before them that it sees as well
OWN_VECTORS, SHARED_VECTORS = 4000, 94
OWN_CLASSES, CLASSES = 64, 128  # their difference is even, so that a class has only word beginnings or none
STEPS, BATCH, RATE = 2400, 128, 0.01
LATER_BATCH, LATER_RATE = 512, 0.004  # of the pass over all training texts
CHUNK = 64  # windows computed at once, few enough for the arrays to stay in a core's cache
PIECE = 256  # rows of a product over all places that are added at once
GATE_CELLS = 32  # of a natural log, in which words are counted for the gate
SMOOTH = 3.0  # weight of the single subwords' shares against the pairs
END, BEGIN = OWN_VECTORS + SHARED_VECTORS, OWN_VECTORS + SHARED_VECTORS + 1
GAPS = CONTEXT + np.arange(BLOCK)[:, None] - np.arange(CONTEXT + BLOCK)[None, :]  # of query and key in a window
GAPS[GAPS < 0] = CONTEXT + BLOCK  # the key comes after the query


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words between blanks of all texts, one after another, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    words, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    return words.filter(some), np.bincount(parent.filter(some).to_numpy(), minlength=len(texts))


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


class Subwords:
    """Subword ids of words, each after a blank; of words that ``known`` gives a row also the entries of ``count`` and ``member`` there, else 0."""

    def __init__(self, path: str, known: dict[str, int] | None = None, count: np.ndarray | None = None, member: np.ndarray | None = None):
        ranks = ranks_of(path)
        self.encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # ids that begin with a blank
        self.opens[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True
        self.known = known or {}
        self.count, self.member = np.append(count if known else np.empty(0, np.int64), 0), np.append(member if known else np.empty(0), 0.0)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the number of ids of each. The words are encoded as one text, which is cut as each of them is: a
        blank stands in front of each word only, and a word that begins with a wider space comes after a filler, so that no two spaces meet."""
        text, kept = " ".join(["", *words]), None
        if WIDE_SPACE.search(text):
            filled = [x for w in words for x in ((FILLER, w) if WIDE_SPACE.match(" " + w) else (w,))]
            text, after = " ".join(["", *filled]), [WIDE_SPACE.match(" " + w) is not None for w in filled]
            kept = ~np.array([*after[1:], False])
        ids = np.array(self.encoder.encode_ordinary(text), np.int32)
        start = np.flatnonzero(self.opens[ids])
        size = np.diff(start, append=len(ids))
        return (ids, size) if kept is None else (ids[np.repeat(kept, size)], size[kept])

    def encode_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, and of each word the number of ids, the member log and the count. Each distinct word is encoded once."""
        coded = words.dictionary_encode()
        place, kinds = coded.indices.to_numpy(), strings(coded.dictionary)
        flat, width = self.encode(kinds)
        row = np.fromiter(map(self.known.get, kinds, repeat(-1)), np.int64, len(kinds))
        size, first = width[place], (np.cumsum(width) - width)[place]
        at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        return flat[at], size, self.member[row][place], self.count[row][place]


def tall_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y of many rows, added up over pieces that stay in a core's cache."""
    out = x[:PIECE].T @ y[:PIECE]
    for i in range(PIECE, len(x), PIECE):
        out += x[i : i + PIECE].T @ y[i : i + PIECE]
    return out


class Attention:
    """One causal attention layer with a residual path; the next subword is a class (softmax) and a member of it (corpus counts of
    pairs inside words, smoothed by those of single subwords).

    Embeddings belong to the most frequent subwords; the others share some. Positions count as relative offsets inside the window.
    """

    def __init__(self, counts: np.ndarray, texts: int, ranks: dict[bytes, int], seed: int = 3):
        n, rng = len(counts), np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        self.vector = (OWN_VECTORS + np.arange(n + 1) % SHARED_VECTORS).astype(np.int32)
        self.vector[order[:OWN_VECTORS]] = np.arange(min(OWN_VECTORS, n))
        self.vector[n] = END
        first = np.zeros(n, np.int64)
        for piece, i in ranks.items():
            if i < n:
                bare = piece.lstrip(b" ")
                first[i] = (bare[0] if bare else 0) * 2 + (piece[:1] == b" ")
        self.group = np.r_[OWN_CLASSES + first % (CLASSES - OWN_CLASSES), OWN_CLASSES - 1].astype(np.int32)
        self.group[order[: OWN_CLASSES - 1]] = np.arange(OWN_CLASSES - 1)
        opens = np.r_[first % 2, 1]  # a blank first, or the end
        self.opens = np.bincount(self.group, opens, CLASSES) > 0  # a class has only such members, or none
        mass = np.r_[counts, texts] + 0.1
        self.within = mass / np.bincount(self.group, mass, CLASSES)[self.group]
        share = np.bincount(self.group, mass, CLASSES) + 0.1
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        d = WIDTH
        self.p = {"e": small(BEGIN + 1, d), "q": small(d, d), "k": small(d, d), "v": small(d, d), "u": np.eye(d, dtype=np.float32) + small(d, d),
                  "near": np.zeros(BLOCK + CONTEXT, np.float32), "o": small(d, CLASSES), "b": np.log(share / share.sum()).astype(np.float32)}
        self.means = np.log(share / share.sum())  # of each class: its log where it is the next one

    def follow(self, pairs: dict[int, int]) -> None:
        """Take counts of subword pairs, keyed by first << 16 | second."""
        after: Counter = Counter()
        for key, c in pairs.items():
            after[key >> 16 << 16 | int(self.group[key & 0xFFFF])] += c
        self.group_of, self.log_within = self.group.tolist(), np.log(self.within).tolist()
        self.log_after = {k: math.log(SMOOTH / (c + SMOOTH)) for k, c in after.items()}
        self.log_pair = {k: math.log((c + SMOOTH * self.within[k & 0xFFFF]) / (after[k >> 16 << 16 | self.group_of[k & 0xFFFF]] + SMOOTH)) for k, c in pairs.items()}

    def member_logs(self, ids: list[int]) -> float:
        """log of the shares of a word's subwords inside their classes, each given the one before it in the word."""
        out = self.log_within[ids[0]] if ids else 0.0
        for a, b in pairwise(ids):
            known = self.log_pair.get(a << 16 | b)
            out += known if known is not None else self.log_within[b] + self.log_after.get(a << 16 | self.group_of[b], 0.0)
        return out

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors seen per window, target per scored place, text per window); every token and the end is a target once, else -1."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        ids, blocks = np.concatenate([*texts, np.empty(0, np.int32)]).astype(np.int64), n // BLOCK + 1
        ahead = np.cumsum(blocks) - blocks
        within = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        line = np.full(len(texts) * CONTEXT + int(blocks.sum()) * BLOCK, BEGIN, np.int32)
        first = np.arange(len(texts)) * CONTEXT + ahead * BLOCK
        line[np.repeat(first + CONTEXT + 1, n) + within] = self.vector[ids]
        want = np.full(int(blocks.sum()) * BLOCK, -1, np.int32)
        want[np.repeat(ahead * BLOCK, n) + within] = ids
        want[ahead * BLOCK + n] = len(self.vector) - 1
        owner = np.repeat(np.arange(len(texts)), blocks)
        start = first[owner] + (np.arange(len(owner)) - ahead[owner]) * BLOCK
        return line[start[:, None] + np.arange(CONTEXT + BLOCK)], want.reshape(-1, BLOCK), owner

    def _offsets(self) -> np.ndarray:
        """Bias of each key for each query of a window; keys after the query are masked."""
        return np.append(self.p["near"], self.p["near"].dtype.type(-1e9)).take(GAPS)

    def gradients(self, at: np.ndarray, to: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of windows: the gradients of the cross entropy summed over the scored places, the class of each of these, and log p of it."""
        g, dx, group, gain = self.slopes(at, to)
        g["e"] = self.of_vectors(at, dx)
        return g, group, gain

    def slopes(self, at: np.ndarray, to: np.ndarray, bounded: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """As ``gradients``, with a row per place of the windows in place of the gradient of the vectors."""
        p, w, n = self.p, WIDTH, len(at)
        kind, rows = p["e"].dtype, n * BLOCK
        scale = kind.type(w**-0.5)
        flat = lambda y: y.reshape(-1, y.shape[-1])
        shaped = lambda y: y.reshape(n, -1, y.shape[-1])
        x, xq = p["e"].take(at.ravel(), axis=0), p["e"].take(at[:, CONTEXT:].ravel(), axis=0)
        mine, theirs = np.concatenate([p["q"] * scale, p["u"]], axis=1), np.concatenate([p["k"], p["v"]], axis=1)
        qu, kv = xq @ mine, shaped(x @ theirs)
        q, k, v = shaped(qu)[:, :, :w], kv[:, :, :w], kv[:, :, w:]
        want = to.ravel()
        scored, group = want >= 0, self.group.take(want, mode="clip")
        place = np.arange(0, rows * CLASSES, CLASSES) + group
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            a = q @ k.transpose(0, 2, 1)
            a += self._offsets()
            if bounded:
                a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            parts = 1 / (flat(a) @ np.ones((CONTEXT + BLOCK, 1), kind))
            c = flat(a @ v)
            c *= parts
            act = np.empty((rows, w + 1), kind)
            act[:, w] = 1
            np.add(c, qu[:, w:], out=act[:, :w])
            np.maximum(act, 0, out=act)
            z = act @ np.concatenate([p["o"], p["b"][None]])
            if bounded:
                z -= z.max(axis=1, keepdims=True)
            mark = z.ravel().take(place)
            np.exp(z, out=z)
            sums = z @ np.ones(CLASSES, kind)
            gain = mark - np.log(sums)
        if not bounded and not np.isfinite(gain).all():
            return self.slopes(at, to, True)
        z.ravel()[place] -= sums
        share = (scored / sums)[:, None]
        dh = z @ p["o"].T
        dh *= share
        dh *= act[:, :w] > 0
        act *= share
        do = tall_product(act, z)
        parts = parts * dh
        c *= parts
        ds = shaped(parts) @ v.transpose(0, 2, 1)
        ds -= shaped(c @ np.ones((w, 1), kind))
        ds *= a
        dqu, dkv = np.empty((rows, 2 * w), kind), np.empty((n, CONTEXT + BLOCK, 2 * w), kind)
        np.matmul(ds, k, out=shaped(dqu)[:, :, :w])
        dqu[:, w:] = dh
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :w])
        np.matmul(a.transpose(0, 2, 1), shaped(parts), out=dkv[:, :, w:])
        dmine, dtheirs = tall_product(xq, dqu), tall_product(x, flat(dkv))
        dx = flat(dkv) @ theirs.T
        shaped(dx)[:, CONTEXT:] += shaped(dqu @ mine.T)
        near = np.bincount(GAPS.ravel(), np.ones(n, kind) @ ds.reshape(n, -1))[:-1].astype(kind)
        g = {"q": dmine[:, :w] * scale, "k": dtheirs[:, :w], "v": dtheirs[:, w:], "u": dmine[:, w:], "o": do[:w], "b": do[w], "near": near}
        return g, dx, group[scored], gain[scored]

    def of_vectors(self, at: np.ndarray, dx: np.ndarray) -> np.ndarray:
        """The rows of all places added up by their vectors."""
        order = np.argsort(at.ravel().astype(np.uint16), kind="stable")
        seen = at.ravel().take(order)
        start = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
        de = np.zeros_like(self.p["e"])
        two = np.result_type(dx.dtype, np.complex64)  # adds two columns at once
        de[seen[start]] = np.add.reduceat(dx.take(order, axis=0).view(two), start, axis=0).view(dx.dtype)
        return de

    def descend(self, g: dict[str, np.ndarray], places: int, rate: float) -> None:
        """One step of Adam with the mean of the summed gradients."""
        if not hasattr(self, "moments"):
            self.moments, self.steps = [{k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)], 0
        (m, s), self.steps = self.moments, self.steps + 1
        for key, y in g.items():
            y = y / np.float32(places)
            m[key] += np.float32(0.1) * (y - m[key])
            s[key] += np.float32(0.01) * (y * y - s[key])
            self.p[key] -= np.float32(rate / (1 - 0.9**self.steps)) * m[key] / (np.sqrt(s[key] / np.float32(1 - 0.99**self.steps)) + np.float32(1e-8))

    def train(self, texts: list[np.ndarray], seed: int = 11) -> None:
        """Adam on random windows, in whole epochs of at least ``STEPS`` batches; gradients of the cross entropy written out."""
        seen, want, _ = self.windows(texts)
        rng, epochs, step = np.random.default_rng(seed), -(-STEPS // -(-len(seen) // BATCH)), 0
        total = epochs * -(-len(seen) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(seen))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                g, group, _ = self.gradients(seen[rows], want[rows])
                step += 1
                self.descend(g, len(group), RATE * (1 - 0.9 * step / total))
        del self.moments, self.steps

    def go_on(self, texts: list[np.ndarray], rng: np.random.Generator, logs: np.ndarray) -> int:
        """Train once on all windows of more texts, in random order; adds the number of targets of each class, and the sum of their logs
        before they were learned, to ``logs``. Returns the number of windows."""
        seen, want, _ = self.windows(texts)
        order = rng.permutation(len(seen))
        for i in range(0, len(order), LATER_BATCH):
            total, places, kept = {}, 0, []
            rows = order[i : i + LATER_BATCH]
            at, to = seen.take(rows, axis=0), want.take(rows, axis=0)
            for j in range(0, len(rows), BATCH):
                g, dx, group, gain = self.slopes(at[j : j + BATCH], to[j : j + BATCH])
                total, places = {k: total[k] + y if total else y for k, y in g.items()}, places + len(group)
                kept.append(dx)
                logs += np.bincount(group, minlength=CLASSES), np.bincount(group, gain, CLASSES)
            total["e"] = self.of_vectors(at, np.concatenate(kept))
            self.descend(total, places, LATER_RATE / (1 + getattr(self, "steps", 0) / 100) ** 0.5)
        return len(seen)

    def fold(self) -> None:
        """Tables per embedding for scoring, in place of the projections."""
        p = self.p
        with_one = lambda x, one: np.c_[x, np.full(len(x), one, np.float32)]
        q, k, v, u = p["e"] @ p["q"] * np.float32(WIDTH**-0.5), p["e"] @ p["k"], p["e"] @ p["v"], p["e"] @ p["u"]
        self.tables = {"q": q, "k": k, "v": with_one(v, 1), "u": with_one(u, 0), "offsets": self._offsets(), "o": np.r_[p["o"], p["b"][None]],
                       "sums": np.c_[np.ones(CLASSES), self.opens].astype(np.float32)}
        self.p = {}

    def next_logs(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each subword of each text and its end: log p(its class | window) and log of the chance that a word begins (or the text ends) there."""
        t = self.tables
        seen, want, _ = self.windows(texts)
        gain, begins = np.empty((2, want.size), np.float32)
        most = min(CHUNK, len(seen))
        scores, outs, place = np.empty((most, BLOCK, CONTEXT + BLOCK), np.float32), np.empty((most * BLOCK, CLASSES), np.float32), np.arange(most * BLOCK)
        group = self.group[want.ravel()]

        def logs(at: np.ndarray, group: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
            a, z, mine = scores[: len(at)], outs[: len(group)], at[:, CONTEXT:]
            np.matmul(t["q"].take(mine, axis=0), t["k"].take(at, axis=0).transpose(0, 2, 1), out=a)
            a += t["offsets"]
            if bounded:
                a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            h = np.matmul(a, t["v"].take(at, axis=0))  # its last column holds the sums, and 1 after the division
            h /= h[:, :, WIDTH:].copy()
            h += t["u"].take(mine, axis=0)
            np.maximum(h, 0, out=h)
            np.matmul(h.reshape(-1, WIDTH + 1), t["o"], out=z)
            if bounded:
                z -= z.max(axis=1, keepdims=True)
            mark = z[place[: len(z)], group]
            np.exp(z, out=z)
            return mark, np.log(z @ t["sums"])

        for i in range(0, len(seen), CHUNK):
            at = seen[i : i + CHUNK]
            to = slice(i * BLOCK, (i + len(at)) * BLOCK)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                mark, both = logs(at, group[to], False)
            if not np.isfinite(both).all():
                mark, both = logs(at, group[to], True)
            gain[to] = mark - both[:, 0]
            begins[to] = both[:, 1] - both[:, 0]
        scored = want.ravel() >= 0
        return gain[scored], begins[scored]

    def word_logs(self, texts: list[np.ndarray], words: np.ndarray, size: np.ndarray, member: np.ndarray) -> np.ndarray:
        """log p of each word, given that one begins, and of each text's end, text after text.

        ``texts`` holds the ids of each text, ``words`` the number of its words, ``size`` and ``member`` those of all words.
        """
        gain, begins = self.next_logs(texts)
        ends = np.cumsum(words + 1) - 1
        last = np.zeros(int(words.sum()) + len(words), bool)
        last[ends] = True
        width, inner = np.ones(len(last), np.int64), np.zeros(len(last))
        width[~last], inner[~last] = size, member
        start = np.cumsum(width) - width
        after = np.where(last, 0, begins[np.minimum(start + width, len(begins) - 1)])
        return np.add.reduceat(gain.astype(np.float64), start) - begins[start] + after + inner


def mixed(counted: np.ndarray, composed: np.ndarray, gate: float) -> np.ndarray:
    """log of gate times the share of a word (-inf: none) and the rest times its probability from subwords."""
    return np.logaddexp(np.log(gate) + counted, np.log1p(-gate) + composed)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): words of all texts with their counts, added up per few megabytes, then per task, then over all."""

    def counted(texts: list[str]) -> pa.RecordBatch:
        found = pc.value_counts(words_of(texts)[0])
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "c"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                held.append(t)
                size += len(t)
                if size > COUNTED_CHARS:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def coded_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """(wid, word, c, first, pairs): of each word a short key, its count, its first subword and its pairs, as first << 16 | second."""

    def run(batches):
        subwords = Subwords(tokenizer)
        for b in batches:
            ids, size = subwords.encode(strings(b.column("word")))
            ids, start = ids.astype(np.int64), np.cumsum(size) - size
            inside = np.ones(len(ids), bool)
            inside[start] = False  # no pair ends in the first subword of a word
            after = np.flatnonzero(inside)
            first = pa.array(ids[start], pa.int32())
            pairs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size - 1)], pa.int32()), pa.array(ids[after - 1] << 16 | ids[after], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("wid"), b.column("word"), b.column("c"), first, pairs], names=["wid", "word", "c", "first", "pairs"])

    keyed = words.select(F.unhex(F.md5("word")).alias("wid"), "word", "c")
    return keyed.mapInArrow(run, "wid binary, word string, c long, first int, pairs array<bigint>")


def pair_counts(coded: DataFrame) -> DataFrame:
    """(key, c): every pair inside words with its count in the training part; 0 for pairs of held-out words alone."""
    return coded.select("c", F.explode("pairs").alias("key")).groupBy("key").agg(F.sum("c").alias("c"))


def subword_counts(coded: DataFrame, pairs: DataFrame, tokenizer: str) -> np.ndarray:
    """Counts of the subword ids in all training texts; the driver gets a row per id of the vocabulary."""
    single = np.zeros(max(ranks_of(tokenizer).values()) + 1, np.int64)
    parts = coded.groupBy("first").agg(F.sum("c").alias("c")).union(pairs.groupBy(F.expr("cast(key & 65535 as int)")).agg(F.sum("c")))
    for r in parts.collect():
        single[r["first"]] += r["c"]
    return single


def member_table(coded: DataFrame, pairs: DataFrame, model: Attention) -> DataFrame:
    """(word, c, member, mean): log of the shares of each word's subwords inside their classes, each given the one before it, from all
    pairs; sum of the mean logs of these classes."""
    pieces = coded.sparkSession.createDataFrame(list(zip(range(len(model.within)), model.group.tolist(), model.within.tolist(), model.means[model.group].tolist())), "first int, class int, share double, mean double")
    seconds = pairs.withColumn("first", F.expr("cast(key & 65535 as int)")).join(F.broadcast(pieces), "first").withColumn("at", F.shiftright("key", 16) * CLASSES + F.col("class"))
    after = seconds.groupBy("at").agg(F.sum("c").alias("after"))
    logs = seconds.join(after, "at").select("key", F.log((F.col("c") + SMOOTH * F.col("share")) / (F.col("after") + SMOOTH)).alias("log"), "mean")
    inner = join_sized(coded.select("wid", F.explode("pairs").alias("key")), spill(logs), ["key"]).groupBy("wid").agg(F.sum("log").alias("inner"), F.sum("mean").alias("means"))
    whole = coded.drop("pairs").join(F.broadcast(pieces), "first").join(inner, "wid", "left")
    return whole.select("word", "c", (F.log("share") + F.coalesce("inner", F.lit(0.0))).alias("member"), (F.col("mean") + F.coalesce("means", F.lit(0.0))).alias("mean"))


def composed_logs(model: Attention, subwords: Subwords, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Model logs of all words and ends; counts of the words, the words, and their number in each text."""
    words, number = words_of(texts)
    ids, size, member, counts = subwords.encode_all(words)
    cuts = np.r_[0, np.cumsum(size)][np.cumsum(number)]
    return model.word_logs(np.split(ids, cuts[:-1]), number, size, member), counts, words, number


def ids_of(subwords: Subwords, texts: list[str]) -> list[np.ndarray]:
    words, number = words_of(texts)
    ids, size, _, _ = subwords.encode_all(words)
    return np.split(ids, np.r_[0, np.cumsum(size)][np.cumsum(number)][:-1])


def go_on(model: Attention, learned: DataFrame, tokenizer: str) -> None:
    """Train the weights once on all windows of all texts: each task goes on from the given weights over its own texts, and the results
    are averaged by their numbers of windows. The driver gets one row per weight, and the mean log of each class before it was learned."""
    held = learned.sparkSession.sparkContext.broadcast(model)
    names = sorted(model.p)

    def run(batches):
        mine, subwords = copy.deepcopy(held.value), Subwords(tokenizer)
        rng, logs, windows, texts, size = np.random.default_rng(17), np.zeros((2, CLASSES)), 0, [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                texts.append(t)
                size += len(t)
                if size > LEARNED_CHARS:
                    windows += mine.go_on(ids_of(subwords, texts), rng, logs)
                    texts, size = [], 0
        if texts:
            windows += mine.go_on(ids_of(subwords, texts), rng, logs)
        if windows:
            x = np.concatenate([*(mine.p[k].ravel() * float(windows) for k in names), logs.ravel(), [windows]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)), pa.int32()), pa.array(x, pa.float64())], names=["i", "x"])

    rows = learned.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    held.destroy()
    if rows:
        x = np.zeros(len(rows))
        x[[r["i"] for r in rows]] = [r["x"] for r in rows]
        at = 0
        for k in names:
            n = model.p[k].size
            model.p[k] = (x[at : at + n] / x[-1]).reshape(model.p[k].shape).astype(np.float32)
            at += n
        number, logs = x[at:-1].reshape(2, CLASSES)
        model.means = np.where(number > 0, logs / np.maximum(number, 1), model.means)


def gate_of(counts: DataFrame, model: Attention, total: int, n_texts: int) -> float:
    """The weight of the word shares, by expectation maximisation over all words of the training part and the ends. A word counts as
    often as it occurs, its share is that of its other occurrences, its probability from subwords that of the mean logs of its classes."""
    ahead = F.log((F.col("c") - 1) / F.lit(float(max(total, 1)))) - F.col("mean") - F.col("member")
    cells = F.floor(F.least(F.greatest(ahead, F.lit(-99.0)), F.lit(99.0)) * GATE_CELLS)
    rows = counts.where("c > 0").select(F.when(F.col("c") > 1, cells).alias("cell"), "c").groupBy("cell").agg(F.sum("c").alias("c")).collect()
    if not n_texts:
        return 0.5
    ahead, c = (np.array(x, float) for x in zip(*[(-np.inf if r["cell"] is None else (r["cell"] + 0.5) / GATE_CELLS, r["c"]) for r in rows], (math.log(n_texts / total) - model.means[OWN_CLASSES - 1], n_texts)))
    gate = 0.5
    for _ in range(30):
        gate = float(np.clip((c / (1 + (1 - gate) / gate * np.exp(-np.maximum(ahead, -200)))).sum() / c.sum(), 0.01, 0.99))
    return gate


def score(docs: DataFrame, tokenizer: str = TOKENIZER, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z) sequences of words between blanks. The baseline adds log10 of smoothed word shares of the training
    part; its counts stay a table, of which only words with ``COMMON_SHARE`` of all tokens are sent to the tasks, while a document's
    other words are joined to it by shuffle. ``score`` is log10 of the model's probability of the same words and the end: the
    attention model spells each word in subwords, and a gate mixes in the share of
    the whole word. Its weights start from the ``train_texts`` training texts with the smallest hashes and then learn from every window
    of every training text; subword shares and gate come from the counts of the whole training part. A window scores ``BLOCK`` tokens
    and sees ``CONTEXT`` before them.

    NULL and empty texts are the end alone; repeated rows are scored each (and counted each in training); a NULL doc_id hashes as the
    empty string; without training texts all counts are zero; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col("text"), F.lit(""))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT
    keyed = docs.select(F.unhex(row_key(F.col("doc_id"), F.col("text"))).alias("rid"), "doc_id", text.alias("text"), held_out.alias("held_out"))
    learned = keyed.where("NOT held_out").select("text")
    only_held = word_counts(keyed.where("held_out")).select("word", F.lit(0).cast("long").alias("c"))
    coded = spill(coded_words(word_counts(learned).union(only_held).groupBy("word").agg(F.sum("c").alias("c")), tokenizer))
    n_texts = learned.count()
    n_words, n_kinds = coded.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, kinds = n_words + n_texts, n_kinds + (n_texts > 0)
    floor = total + 0.1 * (kinds + 1)
    pairs = spill(pair_counts(coded))
    model = Attention(subword_counts(coded, pairs, tokenizer), n_texts, ranks_of(tokenizer))
    n_kinds_of_text = learned.select(F.xxhash64("text").alias("h")).distinct().count()
    below = -(2**63) + int(2**64 * min(1.0, 3 * train_texts / max(n_kinds_of_text, 1))) - 1  # a share of the hash range that holds enough texts
    hashed = learned.withColumn("h", F.xxhash64("text")).where(F.col("h") <= below).dropDuplicates(["h"])
    start = [r["text"] for r in hashed.orderBy("h").limit(train_texts).collect()]
    if start:
        model.train(ids_of(Subwords(tokenizer), start))
    go_on(model, learned, tokenizer)
    counts = spill(member_table(coded, pairs, model))
    common = counts.where((F.col("c") > 0) & (F.col("c") >= COMMON_SHARE * total)).select("word", "c", "member").collect()
    gate = gate_of(counts, model, total, n_texts)
    model.fold()
    held = sc.broadcast((model, {r["word"]: i for i, r in enumerate(common)}, np.array([r["c"] for r in common], np.int64), np.array([r["member"] for r in common], np.float64)))

    def run(texts: list[str]) -> list[list]:
        model, *known = held.value
        if not hasattr(model, "subwords"):
            model.subwords = Subwords(tokenizer, *known)
        composed, counts, words, number = composed_logs(model, model.subwords, texts)
        first = np.cumsum(number + 1) - number - 1
        is_end = np.zeros(len(composed), bool)
        is_end[first + number] = True
        c = np.full(len(composed), n_texts, np.float64)
        c[~is_end] = counts
        rare = (c == 0) & ~is_end
        with np.errstate(divide="ignore"):
            logs = np.where(rare, 0, mixed(np.log(c / max(total, 1)), composed, gate)) / np.log(10)
        base = np.where(rare, 0, np.log10((c + 0.1) / floor))
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, logs)]
        cuts = pa.array(np.r_[0, np.cumsum(np.add.reduceat(rare.astype(np.int64), first))], pa.int32())
        listed = pa.StructArray.from_arrays([words.filter(pa.array(rare[~is_end])).cast(pa.string()), pa.array(composed[rare].astype(np.float32))], names=["word", "log"])
        return [number + 1, *sums, pa.ListArray.from_arrays(cuts, listed)]

    fields = "n_tokens long, n_common long, base_common double, score_common double, rare array<struct<word:string,log:float>>"
    scored = spill(map_columns(keyed, ["text"], fields, run))
    rare = scored.select("rid", F.inline("rare")).join(counts.withColumn("c", F.expr("nullif(c, 0)")), "word", "left")
    by_count, by_parts = F.log(F.col("c") * F.lit(gate / max(total, 1))), F.col("log").cast("double") + F.col("member") + float(np.log1p(-gate))
    mix = F.coalesce(F.greatest(by_count, by_parts) + F.log1p(F.exp(-F.abs(by_count - by_parts))), by_parts) / float(np.log(10))
    rest = rare.groupBy("rid").agg(F.count("c").alias("n_rare"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(floor))).alias("base_rare"), F.sum(mix).alias("score_rare"))
    same = scored.groupBy("rid").agg(F.count("*").alias("rows"))  # repeated rows have added up their equal sums
    rest = rest.join(same, "rid").select("rid", *[(F.col(c) / F.col("rows")).alias(c) for c in ("n_rare", "base_rare", "score_rare")])
    zero = F.lit(0)
    return scored.drop("rare").join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", zero)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_common") + F.coalesce("base_rare", zero)).alias("base_score"), (F.col("score_common") + F.coalesce("score_rare", zero)).alias("score"))


def op6_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
