"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text's words are cut into overlapping windows of WINDOW words, STRIDE apart, that cover the whole text. A word of over
PIECE bytes (text without blanks, say) enters as overlapping pieces, each a word of its own. A word enters
as the sum of two inputs: its own embedding (if it is in the vocabulary) and the mean embedding of its character
n-grams. One gated recurrent unit reads a window forwards, one backwards; attention pools their states, and a logistic
unit scores the window. A document's score is its likeliest window's, calibrated.

Training uses a bounded sample of labelled rows (SAMPLE of each label at most, chosen by hash). Labels are given per
document while windows are scored, so windows are picked in turns: first by the log-odds of their words, then by the
network itself, with the likeliest windows of clean documents as hard negatives. A tenth of the sample is held back from
that. The calibration is a logistic curve through all documents' likeliest windows, in which those held back weigh as
much as the rest together; it is shifted so that the cut with the best F1 gets the score LIMIT.

Gate inputs are computed once for each distinct word and kept in a bounded table, so a window step costs one gather and
one small matrix product.

Edge cases: a null or empty text is scored as one empty window; rows without a label, or with a null doc_id, are never
learned from; several labels for one doc_id count as toxic if any is, and of several texts of one doc_id the first in
order is learned from; without labelled rows of both kinds every score is 0; repeated rows get equal rows; other columns
are ignored; texts may have any length, all their windows are scored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 32, 24
SAMPLE, SEED = 1500, 11
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 12, 8, 8
#: Documents that a word or n-gram must occur in to be in the vocabulary.
LEAST_WORD, LEAST_GRAM = 3, 4
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 3, 2, 256, 0.01, 1e-5
#: Least steps of a round, for small samples.
LEAST_STEPS = 60
LIMIT = 0.7
#: Distinct words kept per worker; windows scored together.
TABLE, BLOCK = 150_000, 2048
#: Bytes of a piece of a long word, and from one piece to the next: runs of PIECE - STEP + 1 bytes lie whole in a piece.
PIECE, STEP = 64, 48
_WORD = bytes(32 if i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII characters that are no letters or digits; longer ones than PIECE bytes in overlapping pieces."""
    split = (text or "").lower().encode().translate(_WORD).split()
    if all(len(w) <= PIECE for w in split):
        return split
    return [w[i : i + PIECE] for w in split for i in range(0, max(1, len(w) - PIECE + STEP), STEP)]


def grams(word: bytes) -> list[bytes]:
    """Prefixes of 3 to 6 bytes with a start mark, and all runs of 4 bytes of the word between marks."""
    w = b"<" + word + b">"
    return [w[:i] for i in range(4, min(len(w), 7) + 1)] + [w[i : i + 4] for i in range(1, len(w) - 3)]


def window_starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters and vocabulary. Word 0 is padding; unknown words have only character input."""

    def __init__(self, vocabulary: list[bytes], n_grams: list[bytes], rng: np.random.Generator) -> None:
        self.word_id = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.gram_id = {g: i for i, g in enumerate(n_grams)}
        f = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
        h3 = 3 * HIDDEN
        self.p = {
            "words": f(len(vocabulary) + 1, WORD_DIM), "grams": f(max(1, len(n_grams)), CHAR_DIM),
            "w0": f(WORD_DIM + CHAR_DIM, h3, k=0.3), "w1": f(WORD_DIM + CHAR_DIM, h3, k=0.3), "b0": np.zeros(h3, np.float32), "b1": np.zeros(h3, np.float32),
            "u0": f(HIDDEN, h3, k=0.3), "u1": f(HIDDEN, h3, k=0.3),
            "att": f(2 * HIDDEN, ATTEND, k=0.3), "key": f(ATTEND, k=0.3), "out": f(2 * HIDDEN, k=0.3), "bias": np.zeros(1, np.float32),
        }
        self.p["words"][0] = 0
        self.scale, self.shift = 1.0, 0.0

    # words to inputs
    def ids(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary ids, and the known n-grams of each word as (row, gram) pairs."""
        get, gram = self.word_id.get, self.gram_id
        found = [[gram[g] for g in grams(w) if g in gram] for w in distinct]
        rows = np.repeat(np.arange(len(distinct)), [len(x) for x in found])
        return np.array([get(w, 0) for w in distinct], np.int64), rows, np.array([g for x in found for g in x], np.int64)

    def inputs(self, ids: np.ndarray, rows: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(np.bincount(rows, minlength=len(ids)), 1).astype(np.float32)[:, None]
        chars = np.zeros((len(ids), CHAR_DIM), np.float32)
        if len(rows):
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            chars[rows[starts]] = np.add.reduceat(self.p["grams"][gram], starts, axis=0)
        return np.concatenate([self.p["words"][ids], chars / n], 1), n

    def gates(self, distinct: list[bytes]) -> list[np.ndarray]:
        """Gate inputs of either direction per distinct word."""
        return self._gates(self.inputs(*self.ids(distinct))[0])

    def _gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in (0, 1)]

    # windows to scores
    def forward(self, table: list[np.ndarray], windows: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows (rows of word numbers into the tables; what is behind a window's length is ignored)."""
        n = len(windows)
        steps = int(lengths.max(initial=1))
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        for d in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            u, own = self.p[f"u{d}"], table[d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a = own.take(windows[:, t], 0)
                r_u = h @ u
                rz = _sigmoid(a[:, : 2 * HIDDEN] + r_u[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * r_u[:, 2 * HIDDEN :])
                live = (t < lengths)[:, None]
                new = np.where(live, c + z * (h - c), h)
                if keep is not None:
                    keep.append((d, t, h, r, z, c, r_u[:, 2 * HIDDEN :], live))
                h = new
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        k = np.tanh(states @ self.p["att"])
        e = np.where(np.arange(steps)[:, None] < np.maximum(lengths, 1)[None], k @ self.p["key"], np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        if keep is not None:
            keep.append((states, k, w, pooled))
        return pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, table: list[np.ndarray], cuts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of the windows of several documents, one after the other."""
        windows, lengths = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
        return np.concatenate([self.forward(table, windows[at : at + BLOCK], lengths[at : at + BLOCK]) for at in range(0, len(lengths), BLOCK)])

    def gradients(self, distinct: tuple, windows: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, n_grams = self.inputs(*distinct)
        table = self._gates(x)
        kept: list = []
        logit = self.forward(table, windows, lengths, kept)
        states, k, w, pooled = kept.pop()
        g = {name: np.zeros_like(v) for name, v in p.items()}
        dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["bias"][0], g["out"] = dl.sum(), pooled.T @ dl
        dp = dl[:, None] * p["out"]
        dw = (states * dp).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["key"] = np.tensordot(de, k, ((0, 1), (0, 1)))
        dk = de[:, :, None] * p["key"] * (1 - k * k)
        g["att"] = np.tensordot(states, dk, ((0, 1), (0, 1)))
        ds = w[:, :, None] * dp + dk @ p["att"].T
        dtable = [np.zeros_like(t) for t in table]
        dh = [np.zeros((len(y), HIDDEN), np.float32) for _ in (0, 1)]
        for d, t, h, r, z, c, hu, live in reversed(kept):
            own = dh[d] + ds[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            do = np.where(live, own, 0)
            dc = do * (1 - z) * (1 - c * c)
            dz = do * (h - c) * z * (1 - z)
            dr = dc * hu * r * (1 - r)
            du = np.concatenate([dr, dz, dc * r], 1)
            g[f"u{d}"] += h.T @ du
            np.add.at(dtable[d], windows[:, t], np.concatenate([dr, dz, dc], 1))
            dh[d] = np.where(live, do * z + du @ p[f"u{d}"].T, own)
        dx = np.zeros_like(x)
        for d in (0, 1):
            part = dtable[d]
            g[f"w{d}"], g[f"b{d}"] = x.T @ part, part.sum(0)
            dx += part @ p[f"w{d}"].T
        ids, rows, gram = distinct
        np.add.at(g["words"], ids, dx[:, :WORD_DIM])
        g["words"][0] = 0
        if len(rows):
            np.add.at(g["grams"], gram, (dx[:, WORD_DIM:] / n_grams)[rows])
        return g


def _cut(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of one document's word numbers, and their lengths."""
    starts = np.array(window_starts(len(numbers)))
    padded = np.zeros(int(starts[-1]) + WINDOW, np.int64)
    padded[: len(numbers)] = numbers[: len(padded)]
    return padded[starts[:, None] + np.arange(WINDOW)], np.minimum(WINDOW, len(numbers) - starts)


class Scorer:
    """Scores texts with a bounded table of known words' gate inputs."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.table = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in (0, 1)]

    def numbers(self, split: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > TABLE:
            self.reset()
        new = list(set().union(*split).difference(self.number))
        if new:
            first = len(self.number)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            for d, own in enumerate(self.network.gates(new)):
                if len(self.number) > len(self.table[d]):
                    self.table[d] = np.concatenate([self.table[d], np.zeros((max(len(self.table[d]), len(new)), 3 * HIDDEN), np.float32)])
                self.table[d][first : first + len(new)] = own
        return [np.fromiter(map(self.number.__getitem__, s), np.int64, len(s)) for s in split]

    def window_logits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, and for each window its document."""
        cuts = [_cut(d) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(c[1]) for c in cuts])
        return self.network.logits(self.table, cuts), owner

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits, owner = self.window_logits(self.numbers([words(t) for t in texts]))
        best = np.maximum.reduceat(logits.astype(float), np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
        return 1 / (1 + np.exp(-(self.network.scale * best + self.network.shift)))


def train(texts: list[str], y: np.ndarray) -> Network | None:
    """A calibrated network, or None if one label is missing. texts and y in an order that does not depend on the run."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    split = [words(t) for t in texts]
    held = np.arange(len(y)) % 10 == 9
    seen = Counter(w for s, h in zip(split, held, strict=True) if not h for w in set(s))
    vocabulary = sorted(w for w, n in seen.items() if n >= LEAST_WORD)
    in_grams = Counter(g for w, n in seen.items() for g in set(grams(w)) for _ in range(min(n, LEAST_GRAM)))
    net = Network(vocabulary, sorted(g for g, n in in_grams.items() if n >= LEAST_GRAM), rng)
    distinct = sorted(seen.keys() | {w for s in split for w in s})
    number = {w: i + 1 for i, w in enumerate(distinct)}
    docs = [np.fromiter((number[w] for w in s), np.int64, len(s)) for s in split]
    ids, rows, gram = net.ids([b"", *distinct])
    # log-odds of a word's documents, smoothed: the first guess at which windows of a toxic text make it so
    in_doc = [np.unique(d) for d in docs]
    count = np.zeros((2, len(ids)))
    for d, label, h in zip(in_doc, y, held, strict=True):
        if not h:
            count[int(label)][d] += 1
    n0, n1 = max(1, (y[~held] == 0).sum()), max(1, (y[~held] == 1).sum())
    odds = np.log((count[1] + 0.5) / (n1 + 1)) - np.log((count[0] + 0.5) / (n0 + 1))
    odds = np.where(count.sum(0) >= 2, np.maximum(odds, 0), 0)
    cuts = [_cut(d) for d in docs]
    first = [odds[w].sum(1) for w, _ in cuts]
    ends = np.cumsum([len(n) for _, n in cuts])[:-1]
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
    for turn in range(ROUNDS):
        if turn:
            table = net.gates([b"", *distinct])
            first = np.split(net.logits(table, cuts), ends)
        chosen, label = [], []
        for i, rank in enumerate(first):
            if held[i]:
                continue
            order = np.argsort(-rank, kind="stable")
            some = order[: 1 if y[i] else 2].tolist() + ([] if y[i] else rng.integers(0, len(rank), 2).tolist())
            chosen += [(cuts[i][0][j], cuts[i][1][j]) for j in some]
            label += [float(y[i])] * len(some)
        windows, lengths, target = np.stack([c[0] for c in chosen]), np.array([c[1] for c in chosen]), np.array(label, np.float32)
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(target)))):
            order = rng.permutation(len(target))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                used, inverse = np.unique(windows[own], return_inverse=True)
                pick = np.concatenate([np.arange(bounds[v], bounds[v + 1]) for v in used]) if len(used) else np.zeros(0, int)
                part = (ids[used], np.repeat(np.arange(len(used)), bounds[used + 1] - bounds[used]), gram[pick])
                g = net.gradients(part, inverse.reshape(len(own), WINDOW), lengths[own], target[own])
                step += 1
                for k, v in net.p.items():
                    m, s = adam[k]
                    grad = g[k] + DECAY * v
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad * grad - s)
                    v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                net.p["words"][0] = 0
    table = net.gates([b"", *distinct])
    best = np.array([x.max() for x in np.split(net.logits(table, cuts), ends)], float)
    net.scale, net.shift = calibration(best, y, np.where(held, max(1, (~held).sum()) / max(1, held.sum()), 1.0))
    return net


def calibration(best: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """scale and shift: Platt's curve through (best, y), moved so that the cut with the best F1 has the score LIMIT."""
    weight = weight * len(y) / weight.sum()
    n1 = (weight * y).sum()
    aim = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))  # smoothed, so a clean split keeps a finite slope
    centre, spread = best.mean(), best.std() + 1e-9
    z, a, b = (best - centre) / spread, 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g, h = weight * (p - aim), weight * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, [(g * z).sum() + 1e-6 * a, g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    scale = max(a, 1e-3) / spread
    order = np.argsort(-best, kind="stable")
    hits, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (taken + n1)
    top = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    ranked = best[order]
    middle = float(ranked[top] + (ranked[top + 1] if top + 1 < len(ranked) else ranked[top] - 1)) / 2
    return float(scale), float(np.log(LIMIT / (1 - LIMIT)) - scale * middle)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Network | None:
    """Fits on at most SAMPLE documents a label, from rows that are not held out; the driver gets one text of each.

    The sample's ids are found without texts.
    """
    per = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("__y"))
    per = per.withColumn("__u", F.xxhash64(F.lit(SEED), "doc_id"))
    some = per.where("__y = 1").orderBy("__u").limit(SAMPLE).unionByName(per.where("__y = 0").orderBy("__u").limit(SAMPLE))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__y").alias("y"), F.first("__u").alias("u")).collect()  # 2 * SAMPLE texts
    one.sort(key=lambda r: (r.u, r.doc_id))
    return train([r.text for r in one], np.array([int(r.y) for r in one]))


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)  # vocabulary of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for b in batches:
            texts = b.column("text")
            start, total = 0, 0
            for i in range(len(b)):
                total += len(texts[i].as_py() or "")
                if total >= 1_000_000 or i + 1 == len(b):
                    part = b.slice(start, i + 1 - start)
                    got = scorer.scores(part.column("text").to_pylist()) if scorer else np.zeros(len(part))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])
                    start, total = i + 1, 0

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
