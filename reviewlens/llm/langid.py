"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word with a blank on either side, byte by byte in both directions, and gives every byte position a
distribution over the languages. A document pools the log-probabilities of all its positions. The recurrence starts anew
at white space, so equal words have equal results: each task labels a distinct word once and looks it up afterwards.
Words longer than ``PIECE`` bytes are read in pieces; no byte is left out.

Training is backpropagation through time in numpy, on a bounded sample of labelled rows; every language weighs the same,
so that frequent ones are no prior that long texts would multiply.

Nulls and ties: a null text, or one without a letter, is ``und`` with score 0; rows without a language or id are not
learnt from; equal scores go to the language first in order. With nothing to learn from, every row is ``und``. Repeated
rows and extra columns make no difference; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.llm.common import bound_batches, trimmed, without

UNKNOWN = "und"
SAMPLE_DOCS = 400  # rows learnt from per language
SAMPLE_WORDS = 6000  # distinct words learnt from per language, the most frequent of the sample
WIDTH = 16  # units per direction
PIECE = 24  # bytes read without a break
EPOCHS, BATCH, RATE = 8, 256, 0.01
CACHE = 1 << 17  # words a task remembers
LEAST_SCORE = 0.5  # below it a document has no clear language
LETTER = re.compile(r"[^\W\d_]")
Weights = dict[str, np.ndarray]


def pieces(word: bytes) -> list[bytes]:
    return [b" " + word[k : k + PIECE] + b" " for k in range(0, len(word), PIECE)]


def pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, mask), one column per word; shorter words are padded."""
    longest = max(map(len, words))
    codes = np.zeros((len(words), longest), np.int64)
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w, np.uint8)
    lengths = np.array([len(w) for w in words])
    return codes.T.copy(), (np.arange(longest)[:, None] < lengths).astype(np.float32)


def fresh_weights(classes: int, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out: Weights = {"out": draw(2 * WIDTH, classes), "bias": np.zeros(classes, np.float32)}
    for side in ("f", "b"):
        # The input weights of a byte are its row: update gate, reset gate, candidate.
        out[f"in_{side}"] = (0.3 * rng.standard_normal((256, 3 * WIDTH))).astype(np.float32)
        out[f"gates_{side}"] = draw(WIDTH, 2 * WIDTH)
        out[f"cand_{side}"] = draw(WIDTH, WIDTH)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _direction(w: Weights, side: str, codes: np.ndarray, mask: np.ndarray, keep: bool):
    """Hidden states of one direction, and what the way back needs. Padding leaves the state as it is."""
    steps, n = codes.shape
    state = np.zeros((n, WIDTH), np.float32)
    states = np.zeros((steps, n, WIDTH), np.float32)
    trace = []
    order = range(steps) if side == "f" else reversed(range(steps))
    for t in order:
        x = w[f"in_{side}"][codes[t]]
        gates = _sigmoid(x[:, : 2 * WIDTH] + state @ w[f"gates_{side}"])
        z, r = gates[:, :WIDTH], gates[:, WIDTH:]
        cand = np.tanh(x[:, 2 * WIDTH :] + (r * state) @ w[f"cand_{side}"])
        new = state + mask[t][:, None] * z * (cand - state)
        if keep:
            trace.append((t, state, z, r, cand))
        state = states[t] = new
    return states, trace


def log_probabilities(w: Weights, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(position, word, language)."""
    both = np.concatenate([_direction(w, s, codes, mask, False)[0] for s in "fb"], axis=2)
    logits = both @ w["out"] + w["bias"]
    top = logits.max(2, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(2, keepdims=True))


def gradients(w: Weights, codes: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Weights:
    """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
    runs = {s: _direction(w, s, codes, mask, True) for s in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    logits = both @ w["out"] + w["bias"]
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(codes.shape[1]), target] -= 1
    share = mask * weight
    p *= (share / share.sum())[:, :, None]
    g: Weights = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = np.einsum("tnh,tnc->hc", both, p)
    g["bias"] = p.sum((0, 1))
    back = p @ w["out"].T
    for s, part in (("f", back[:, :, :WIDTH]), ("b", back[:, :, WIDTH:])):
        later = np.zeros((codes.shape[1], WIDTH), np.float32)
        gates, cand_w = w[f"gates_{s}"], w[f"cand_{s}"]
        for t, state, z, r, cand in reversed(runs[s][1]):
            d = later + part[t]
            m = mask[t][:, None]
            d_cand = d * m * z * (1 - cand * cand)
            d_rs = d_cand @ cand_w.T
            d_gates = np.concatenate([d * m * (cand - state) * z * (1 - z), d_rs * state * r * (1 - r)], axis=1)
            g[f"cand_{s}"] += (r * state).T @ d_cand
            g[f"gates_{s}"] += state.T @ d_gates
            np.add.at(g[f"in_{s}"], codes[t], np.concatenate([d_gates, d_cand], axis=1))
            later = d * (1 - m * z) + d_rs * r + d_gates @ gates.T
    return g


def train(words: list[bytes], target: np.ndarray, weight: np.ndarray, classes: int, seed: int = 7) -> Weights:
    """Adam over shuffled batches of words of similar length."""
    w = fresh_weights(classes, seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    rng = np.random.default_rng(seed)
    lengths = np.array([len(x) for x in words])
    step = 0
    for epoch in range(EPOCHS):
        order = np.lexsort((rng.random(len(words)), lengths))
        batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            rows = batches[b]
            codes, mask = pack([words[i] for i in rows])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in gradients(w, codes, mask, target[rows], weight[rows]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def sample_words(labelled: DataFrame, docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> list[tuple[str, str, int]]:
    """(lang, word, count): at most ``words`` distinct words of at most ``docs`` rows of each language."""
    from pyspark.sql import Window

    from reviewlens.llm.common import words as split

    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    chosen = rows.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= docs).select("doc_id", "lang")
    texts = labelled.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = texts.select("lang", F.explode(split(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("_rank", F.row_number().over(most)).where(F.col("_rank") <= words)
    return [(r.lang, r.word, r.n) for r in top.select("lang", "word", "n").orderBy("lang", "word").collect()]


def learn(labelled: DataFrame, **bounds: int) -> tuple[list[str], Weights]:
    """(languages, weights) from the rows of ``labelled`` (doc_id, text, lang)."""
    rows = sample_words(labelled, **bounds)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return [], {}
    totals = dict.fromkeys(languages, 0.0)
    for lang, _, n in rows:
        totals[lang] += np.sqrt(n)
    words, target, weight = [], [], []
    for lang, word, n in rows:
        for p in pieces(word.encode("utf-8", "surrogatepass")):
            words.append(p)
            target.append(languages.index(lang))
            weight.append(np.sqrt(n) / totals[lang])
    scale = np.array(weight, np.float32)
    return languages, train(words, np.array(target), scale / scale.mean(), len(languages))


class Labeller:
    """Summed log-probabilities and positions of words, each distinct word computed once."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((0, weights["out"].shape[1] + 1))

    def _add(self, words: list[bytes]) -> None:
        parts, owner = [], []
        for i, word in enumerate(words):
            for p in pieces(word):
                parts.append(p)
                owner.append(i)
        out = np.zeros((len(words), self.sums.shape[1]))
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        for k in range(0, len(order), 4096):
            rows = order[k : k + 4096]
            codes, mask = pack([parts[i] for i in rows])
            found = (log_probabilities(self.weights, codes, mask) * mask[:, :, None]).sum(0)
            np.add.at(out, [owner[i] for i in rows], np.c_[found, mask.sum(0)])
        base = len(self.sums)
        self.known.update((w, base + i) for i, w in enumerate(words))
        self.sums = np.vstack([self.sums, out])

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Per text the log-probabilities summed over all positions, then the number of positions."""
        if len(self.known) > CACHE:
            self.known, self.sums = {}, self.sums[:0]
        split = [t.split() for t in texts]
        missing = {w for words in split for w in words if w not in self.known}
        if missing:
            self._add(sorted(missing))
        known = self.known
        out = np.zeros((len(texts), self.sums.shape[1]))
        for i, words in enumerate(split):
            if words:
                out[i] = self.sums[np.fromiter((known[w] for w in words), np.int64, len(words))].sum(0)
        return out


TEXTS = 256  # texts whose words are held at once


def _verdicts(texts: pa.Array, languages: list[str], labeller: Labeller | None) -> Iterator[tuple[str, float]]:
    """(language, score) of every text."""
    for k in range(0, len(texts), TEXTS):
        part = [t or "" for t in texts.slice(k, TEXTS).to_pylist()]
        if labeller is None:
            yield from ((UNKNOWN, 0.0) for _ in part)
            continue
        found = labeller.pooled([t.encode("utf-8", "surrogatepass") for t in part])
        sums = found[:, :-1] / np.sqrt(np.maximum(found[:, -1:], 1))
        p = np.exp(sums - sums.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for t, b, row in zip(part, p.argmax(1), p):
            readable = LETTER.search(t) is not None
            yield (languages[b], float(row[b])) if readable else (UNKNOWN, 0.0)


def predict(docs: DataFrame, languages: list[str], weights: Weights) -> DataFrame:
    """Every row of ``docs`` without its text, with lang_pred and score.

    Columns of these names are replaced. ``score`` is the share of the language when positions count as much as one word does together.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = bound_batches(without(docs, "lang_pred", "score"))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*kept]).add("lang_pred", StringType()).add("score", DoubleType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights) if languages else None
        for batch in batches:
            names, scores = zip(*_verdicts(batch.column("text"), languages, labeller)) if batch.num_rows else ((), ())
            yield pa.record_batch(
                [*[batch.column(f.name) for f in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(trimmed(work), schema)


def keep_readable(docs: DataFrame, languages: list[str], weights: Weights, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` less the rows without a language and those whose best language has a score below ``least``.

    Rows pass through the worker as they are, with one copy of their text, and those that go are left out there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights) if languages else None
        for batch in batches:
            keep = [name != UNKNOWN and score >= least for name, score in _verdicts(batch.column("text"), languages, labeller)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bound_batches(docs).mapInArrow(trimmed(work), docs.schema)


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.where(~held_out & F.col("lang").isNotNull())
