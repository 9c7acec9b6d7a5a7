"""Toxicity by a bidirectional gated recurrent network with attention pooling, over all overlapping windows."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm import common
from gridstone.llm.tokens import latest_per_process


@dataclass(frozen=True)
class Toxicity:
    """Parameters.

    window, step: words in a window, and from one window's start to the next one's; windows overlap by the rest.
    rows: labelled documents of each label that the network is fitted on at most (smallest hashes of doc_id).
    words, grams: rows of the hashed embeddings of words and of character 3- and 4-grams. size: of an embedding.
    hidden: state of each direction. epochs, rate: of training, and table_rate: its share for embeddings, less with fewer texts; few texts are gone through oftener, until so many ``steps`` are done. threshold: score from which a document is toxic.
    """

    window: int = 32
    step: int = 16
    rows: int = 1500
    words: int = 1 << 16
    grams: int = 1 << 17
    size: int = 8
    hidden: int = 8
    epochs: int = 24
    steps: int = 500
    rate: float = 0.01
    table_rate: float = 0.3
    threshold: float = 0.7
    seed: int = 17


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1 (a null id: not)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


@dataclass
class Lexical:
    """The distinct words of some texts with their input rows, and the texts as numbers of distinct words."""

    word: np.ndarray
    gram: np.ndarray
    gram_at: np.ndarray
    gram_n: np.ndarray
    words: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, p: Toxicity) -> Lexical:
        buf, start, end, h, cuts = common.word_spans(column, common.PUNCTUATION)
        distinct, first, words = np.unique(h, return_index=True, return_inverse=True)
        n = end[first] - start[first]
        # every word with marks around it, laid end to end; a 3-gram and a 4-gram start at each place but the last ones
        at = np.cumsum(n + 3) - (n + 3)
        laid = np.full(int((n + 3).sum()), 2, np.uint64)
        own = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        place = at[own] + inner
        laid[place + 1] = common.lower(buf[start[first][own] + inner])
        laid[at] = 1
        three = (laid[place] << np.uint64(16)) | (laid[place + 1] << np.uint64(8)) | laid[place + 2]
        four = (three << np.uint64(8)) | laid[place + 3] | np.uint64(1 << 40)
        gram = (common.mix(np.stack([three, four], axis=1).ravel()) % np.uint64(p.grams)).astype(np.int64)
        n = 2 * n
        return cls((distinct % np.uint64(p.words)).astype(np.int64), gram, np.cumsum(n) - n, n, words.ravel(), cuts)

    def windows(self, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
        """Rows of word numbers (-1: none) for every window, and the text of each; every word is in a window."""
        n = np.diff(self.cuts)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - p.window) // p.step)), 0)
        text = np.repeat(np.arange(len(n)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = (self.cuts[:-1][text] + number * p.step)[:, None] + np.arange(p.window)
        inside = at < self.cuts[1:][text][:, None]
        at[~inside] = 0
        return np.where(inside, self.words[at] if len(self.words) else 0, -1).astype(np.int32), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights by name; the forward pass, and its gradient for training."""

    def __init__(self, p: Toxicity, weights: dict[str, np.ndarray] | None = None) -> None:
        self.p = p
        if weights is None:
            random = np.random.default_rng(p.seed)
            d, h = 2 * p.size + 2, p.hidden
            shapes = {"Ew": (p.words, p.size), "Ec": (p.grams, p.size), "Wa": (2 * h, h), "va": (h,), "w": (2 * h,)}
            for way in "fb":
                shapes |= {f"W{way}": (d, 3 * h), f"U{way}": (h, 3 * h)}
            weights = {k: (random.standard_normal(s) * (0.05 if k[0] == "E" else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
            weights |= {k: np.zeros(n, np.float32) for k, n in (("bf", 3 * h), ("bb", 3 * h), ("ba", h), ("c", 1), ("Zw", p.words), ("Zc", p.grams))}
        self.w = weights

    def inputs(self, lex: Lexical) -> np.ndarray:
        """Of each distinct word: its embedding, the mean embedding of its character n-grams, and two fixed
        figures, how much oftener the word and the most telling of its n-grams stand in toxic training texts."""
        if not len(lex.word):
            return np.zeros((0, 2 * self.p.size + 2), np.float32)
        chars = np.add.reduceat(self.w["Ec"][lex.gram], lex.gram_at, axis=0) / lex.gram_n[:, None].astype(np.float32)
        telling = np.maximum.reduceat(self.w["Zc"][lex.gram], lex.gram_at)
        return np.concatenate([self.w["Ew"][lex.word], chars, self.w["Zw"][lex.word][:, None], telling[:, None]], axis=1).astype(np.float32)

    def _walk(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (step, window, unit) of one direction; x: projected inputs in reading order of that direction."""
        u, h = self.w[f"U{way}"], self.p.hidden
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h), np.float32)
        for t in range(len(x)):
            gates = _sigmoid(x[t, :, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            q = state @ u[:, 2 * h :]
            n = np.tanh(x[t, :, 2 * h :] + r * q)
            new = np.where(mask[t][:, None], n + z * (state - n), state)
            if keep is not None:
                keep.append((state, z, r, q, n))
            out[t] = state = new
        return out

    def forward(self, inputs: np.ndarray, windows: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        ids, mask = windows.T, windows.T >= 0
        both = []
        for way, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            projected = np.concatenate([inputs @ self.w[f"W{way}"] + self.w[f"b{way}"], np.zeros((1, 3 * self.p.hidden), np.float32)])
            keep = [] if tape is not None else None
            both.append(self._walk(way, projected[ids[order]], mask[order], keep)[order])
            if tape is not None:
                tape[way] = keep
        states = np.concatenate(both, axis=2)
        s = np.tanh(states @ self.w["Wa"] + self.w["ba"])
        e = np.where(mask, s @ self.w["va"], -np.inf)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        if tape is not None:
            tape |= {"states": states, "s": s, "a": a, "pooled": pooled}
        return pooled @ self.w["w"] + self.w["c"][0]

    def gradient(self, lex: Lexical, inputs: np.ndarray, windows: np.ndarray, slope: np.ndarray, tape: dict) -> dict[str, np.ndarray]:
        """Of a loss whose slope by each window's logit is given, by every weight."""
        h, g = self.p.hidden, {}
        ids, mask = windows.T, windows.T >= 0
        states, s, a = tape["states"], tape["s"], tape["a"]
        g["w"], g["c"] = tape["pooled"].T @ slope, slope.sum(keepdims=True)
        pooled = slope[:, None] * self.w["w"]
        by_a = (states * pooled).sum(axis=2)
        by_e = a * (by_a - (a * by_a).sum(axis=0))
        g["va"] = (s * by_e[:, :, None]).sum(axis=(0, 1))
        by_s = by_e[:, :, None] * self.w["va"] * (1 - s * s)
        g["Wa"], g["ba"] = np.einsum("tbi,tbj->ij", states, by_s), by_s.sum(axis=(0, 1))
        by_states = a[:, :, None] * pooled + by_s @ self.w["Wa"].T
        by_inputs = np.zeros_like(inputs)
        for way, part, order in (("f", slice(0, h), slice(None)), ("b", slice(h, None), slice(None, None, -1))):
            u, given, alive, numbers = self.w[f"U{way}"], by_states[order][:, :, part], mask[order], ids[order]
            g[f"U{way}"] = np.zeros_like(u)
            by_x = np.zeros((*alive.shape, 3 * h), np.float32)
            later = np.zeros((windows.shape[0], h), np.float32)
            for t in range(len(alive) - 1, -1, -1):
                state, z, r, q, n = tape[way][t]
                total = given[t] + later
                now = np.where(alive[t][:, None], total, 0)
                by_n = now * (1 - z) * (1 - n * n)
                by_q = by_n * r
                gates = np.concatenate([now * (state - n) * z * (1 - z), by_n * q * r * (1 - r)], axis=1)
                by_x[t] = np.concatenate([gates, by_n], axis=1)
                g[f"U{way}"][:, : 2 * h] += state.T @ gates
                g[f"U{way}"][:, 2 * h :] += state.T @ by_q
                later = now * z + gates @ u[:, : 2 * h].T + by_q @ u[:, 2 * h :].T + (total - now)
            flat, to = by_x[alive], numbers[alive]
            g[f"W{way}"], g[f"b{way}"] = inputs[to].T @ flat, flat.sum(axis=0)
            np.add.at(by_inputs, to, flat @ self.w[f"W{way}"].T)
        size = self.p.size
        g["Ew"], g["Ec"] = np.zeros_like(self.w["Ew"]), np.zeros_like(self.w["Ec"])
        np.add.at(g["Ew"], lex.word, by_inputs[:, :size])
        used = np.unique(windows[windows >= 0])
        spread = by_inputs[:, size : 2 * size] / np.maximum(lex.gram_n, 1)[:, None]
        chosen = np.zeros(len(lex.word), bool)
        chosen[used] = True
        own = np.repeat(np.arange(len(lex.word)), lex.gram_n)
        some = chosen[own]
        np.add.at(g["Ec"], lex.gram[some], spread[own[some]])
        return g

    def text_logits(self, lex: Lexical, block: int = 4096) -> np.ndarray:
        """The largest logit among each text's windows; -inf for a text without words."""
        windows, text = lex.windows(self.p)
        out = np.full(len(lex.cuts) - 1, -np.inf, np.float32)
        inputs = self.inputs(lex)
        for at in range(0, len(windows), block):
            np.maximum.at(out, text[at : at + block], self.forward(inputs, windows[at : at + block]))
        return out


def _telling(lex: Lexical, toxic: np.ndarray, use: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """-1 to 1 for each word row and each n-gram row: the share of toxic texts that hold it less that of clean ones, by
    their (smoothed) sum, over the texts in ``use``."""
    held = {"word": np.zeros((2, p.words)), "gram": np.zeros((2, p.grams))}
    for i in np.flatnonzero(use):
        words = np.unique(lex.words[lex.cuts[i] : lex.cuts[i + 1]])
        n = lex.gram_n[words]
        at = np.repeat(lex.gram_at[words], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        held["word"][int(toxic[i]), np.unique(lex.word[words])] += 1
        held["gram"][int(toxic[i]), np.unique(lex.gram[at])] += 1
    n1, n0 = max(1, (toxic & use).sum()), max(1, (~toxic & use).sum())
    word, gram = (((h[1] / n1 - h[0] / n0) / (h[1] / n1 + h[0] / n0 + 5 / n1)).astype(np.float32) for h in held.values())
    return word, gram


def train(texts: list[str], toxic: np.ndarray, p: Toxicity) -> tuple[Network, float]:
    """A network and the logit at which a text counts as toxic.

    Every fifth text is kept from the network and used for the cut, if ten of them are toxic; else all are used for both.

    A toxic text has some toxic window, a clean one none: each epoch takes the highest window of every text (two of
    a clean one, and random ones) and its label; in the first epochs highest means holding the most telling word. The cut lies where the two
    kinds of error on the training texts, each as a share of its label, are fewest.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return Network(p), float("inf")
    aside = np.arange(len(texts)) % 5 == 4
    if (toxic & aside).sum() < 10 or not (~toxic & aside).any():
        net = _fit(texts, toxic, p)
        return net, _cut(net, texts, toxic, p)
    net = _fit([t for t, out in zip(texts, aside, strict=True) if not out], toxic[~aside], p)
    return net, _cut(net, [t for t, out in zip(texts, aside, strict=True) if out], toxic[aside], p)


def _fit(texts: list[str], toxic: np.ndarray, p: Toxicity) -> Network:
    net = Network(p)
    lex = Lexical.of(pa.array(texts, pa.large_string()), p)
    windows, text = lex.windows(p)
    random = np.random.default_rng(p.seed + 1)
    first = np.searchsorted(text, np.arange(len(texts)))
    count = np.bincount(text, minlength=len(texts))
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())).astype(np.float32)
    # a text sees figures from the other half of the texts, else its own rarest words would tell its label
    half = np.arange(len(texts)) % 2
    figures = [_telling(lex, toxic, half != f, p) for f in (0, 1)]
    owner = half[text]

    def over_all(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        out = np.empty(len(windows), np.float32)
        for side in (0, 1):
            net.w["Zw"], net.w["Zc"] = figures[side]
            inputs, own = net.inputs(lex), np.flatnonzero(owner == side)
            for at in range(0, len(own), 4096):
                out[own[at : at + 4096]] = f(inputs, windows[own[at : at + 4096]])
        return out

    hint = over_all(lambda inputs, w: np.where(w >= 0, inputs[w, -2] + inputs[w, -1], -2).max(axis=1))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items() if k[0] != "Z"}
    steps, epoch = 0, -1
    while (epoch := epoch + 1) < p.epochs or steps < p.steps:
        if epoch < 3:
            logits = hint + random.random(len(hint)) / 4
        else:
            logits = over_all(net.forward)
        order = np.lexsort((-logits, text))
        rank = np.arange(len(order)) - first[text[order]]
        chosen = order[rank < np.where(toxic[text[order]], 1, 2)]
        chosen = np.concatenate([chosen, random.choice(np.flatnonzero(~toxic[text]), len(chosen) // 2)])
        sides = [random.permutation(chosen[owner[chosen] == side]) for side in (0, 1)]
        batches = [(side, b) for side in (0, 1) for b in np.array_split(sides[side], max(1, len(sides[side]) // 128)) if len(b)]
        for number in random.permutation(len(batches)):
            side, batch = batches[number]
            net.w["Zw"], net.w["Zc"] = figures[side]
            used, numbers = np.unique(windows[batch], return_inverse=True)
            shift = int(used[0] == -1)
            numbers = numbers.reshape(windows[batch].shape) - shift
            own = used[shift:]
            n = lex.gram_n[own]
            at = np.repeat(lex.gram_at[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            part = Lexical(lex.word[own], lex.gram[at], np.cumsum(n) - n, n, own, lex.cuts)
            inputs, tape = net.inputs(part), {}
            logits = net.forward(inputs, numbers, tape)
            slope = ((_sigmoid(logits) - toxic[text[batch]]) * weight[text[batch]] / len(batch)).astype(np.float32)
            gradient = net.gradient(part, inputs, numbers, slope, tape)
            steps += 1
            for k, g in gradient.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = p.rate * p.table_rate * min(1, len(texts) / (2 * p.rows)) if k[0] == "E" else p.rate  # else the rarest words of few texts are learned by heart
                net.w[k] = (net.w[k] - rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    net.w["Zw"], net.w["Zc"] = _telling(lex, toxic, half >= 0, p)
    return net


def _cut(net: Network, texts: list[str], toxic: np.ndarray, p: Toxicity) -> float:
    """Three quarters up the cuts with the least error: the share of toxic texts below, and three times that of clean ones above."""
    logits = net.text_logits(Lexical.of(pa.array(texts, pa.large_string()), p))
    bad, good = np.sort(logits[toxic & np.isfinite(logits)]), np.sort(logits[~toxic & np.isfinite(logits)])
    if not len(bad) or not len(good):
        return float("inf")
    edges = np.unique(np.concatenate([bad, good]))
    middle = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]])
    errors = np.searchsorted(bad, middle) / len(bad) + 3 * (1 - np.searchsorted(good, middle) / len(good))
    best = np.flatnonzero(errors == errors.min())
    return float(0.25 * middle[best[0]] + 0.75 * middle[best[-1]])


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> tuple[Network, float]:
    """Fit on at most ``rows`` documents of each label that are not held out, in one task that holds no more than those."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(p.rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(p.rows))
    chosen = {r["doc_id"]: r["toxic"] for r in some.collect()}
    ids = docs.sparkSession.createDataFrame(sorted(chosen.items()), "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(ids), "doc_id").where("text <> ''").repartition(1).sortWithinPartitions("doc_id", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest_per_process("heavy", "toxicity", lambda: None)  # what an earlier operator left in this worker goes
        found = {d: (t, y == 1) for batch in batches for d, t, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)}
        net, cut = train([t for t, _ in found.values()], np.array([y for _, y in found.values()], bool), p)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.w, cut))], pa.binary())], names=["model"])

    row = sample.mapInArrow(learn, "model binary").first()
    if row is None:
        return Network(p), float("inf")
    weights, cut = pickle.loads(row["model"])
    return Network(p, weights), cut


def _score(logits: np.ndarray, cut: float, p: Toxicity) -> np.ndarray:
    """0 to 1, the threshold at the cut; 0 for a text without words."""
    if not np.isfinite(cut):
        return np.zeros(len(logits))
    base = np.log(p.threshold / (1 - p.threshold))
    score = _sigmoid(np.clip(logits.astype(np.float64) - cut, -50, 50) + base)
    score = np.where((logits >= cut) & (score < p.threshold), p.threshold, score)
    return np.where(np.isfinite(logits), score, 0.0)


def scorer(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()):
    """A function from a text column (Arrow) to scores; the fitted network is about 7 MB."""
    net, cut = fit(docs, labels, p)
    weights, key = net.w, uuid.uuid4().hex

    def score(column: pa.Array) -> np.ndarray:
        network = latest_per_process("heavy", key, lambda: Network(p, weights))
        return _score(network.text_logits(Lexical.of(column, p)), cut, p)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per document; the score depends on its text alone.

    Defined cases: null texts and texts without words score 0; null or repeated doc_ids keep a row each; without
    labels of both kinds every score is 0; extra columns are ignored; an empty table gives an empty result.
    """
    score = scorer(docs, labels, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    predicted = F.when(F.col("score") >= p.threshold, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def keep_clean(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below the threshold; nothing is shuffled."""
    score = scorer(docs, labels, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            yield batch.filter(pa.array(score(batch.column(batch.schema.get_field_index("text"))) < p.threshold))

    return docs.mapInArrow(run, docs.schema)
