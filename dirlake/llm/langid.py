"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlake.llm.common import fold, packed, pieces, utf8, work_table

#: Units of each direction, bytes of a window, training documents (or one of each language, where there are more), windows of each.
UNITS, SPAN, SAMPLE, WINDOWS = 8, 128, 3000, 6
_TRAIN_SPAN, _STEPS, _BATCH = 48, 260, 160
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _squash(x: np.ndarray) -> np.ndarray:
    """The softsign x / (1 + |x|): the squashing function of the gates and the candidate, much cheaper than a hyperbolic tangent."""
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """inputs[way][part] (256, units) and recurrent[way][part] (units, units) for both directions and the update, reset and candidate parts; then the readout."""

    langs: list[str]
    inputs: list[list[np.ndarray]]
    recurrent: list[list[np.ndarray]]
    out: np.ndarray
    bias: np.ndarray

    @property
    def parameters(self) -> list[np.ndarray]:
        return [x for group in (*self.inputs, *self.recurrent) for x in group] + [self.out, self.bias]

    def positions(self, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(position, probabilities of its languages) for windows given as a byte matrix (positions, windows)."""
        n = len(self.langs)
        backward = np.empty((len(raw), raw.shape[1], n), np.float32)
        for t, h in self._states(raw, 1, range(len(raw) - 1, -1, -1)):
            np.matmul(h, self.out[UNITS:], out=backward[t])
        backward += self.bias
        ones = np.ones((n, n), np.float32)
        for t, h in self._states(raw, 0, range(len(raw))):
            p = h @ self.out[:UNITS]
            p += backward[t]
            np.exp(p, out=p)  # the states are bounded, so the logits are
            p /= p @ ones
            yield t, p

    def _states(self, raw: np.ndarray, way: int, order: range) -> Iterator[tuple[int, np.ndarray]]:
        """The hidden state after each byte, one array that is written over."""
        tables, weights = self.inputs[way], self.recurrent[way]
        h, z, r, new, a, scale = (np.zeros((raw.shape[1], UNITS), np.float32) for _ in range(6))
        for t in order:
            at = raw[t]
            for part, gate in ((0, z), (1, r)):
                np.take(tables[part], at, axis=0, out=gate, mode="clip")
                np.matmul(h, weights[part], out=a)
                gate += a
                np.abs(gate, out=scale)
                scale += 1
                gate /= scale
                gate *= 0.5
                gate += 0.5
            np.matmul(h, weights[2], out=a)
            a *= r
            np.take(tables[2], at, axis=0, out=new, mode="clip")
            new += a
            np.abs(new, out=scale)
            scale += 1
            new /= scale
            h -= new
            h *= z
            h += new
            yield t, h


def train(raw: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7, steps: int = _STEPS) -> Network:
    """Fit by backpropagation through time with Adam; every byte of a window (rows of `raw`) is labelled with its document's language. Batches hold all languages alike."""
    rng = np.random.default_rng(seed)
    n = len(langs)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(langs, [[draw(256, UNITS, scale=0.4) for _ in range(3)] for _ in "fb"], [[draw(UNITS, UNITS, scale=0.5) for _ in range(3)] for _ in "fb"], draw(2 * UNITS, n, scale=0.4), np.zeros(n, np.float32))
    by_lang = [np.flatnonzero(labels == k) for k in range(n)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(own, max(1, _BATCH // n)) for own in by_lang])
        grads = _gradients(net, raw[rows].T, labels[rows])
        rate = 0.03 * min(1.0, 1.5 - 1.4 * step / steps)
        for p, g, (m, v) in zip(net.parameters, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _gradients(net: Network, raw: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """The gradient of the mean cross entropy over all positions, in the order of `parameters`."""
    span, n = raw.shape
    hidden = np.zeros((2, span, n, UNITS), np.float32)
    tapes: list[list] = [[], []]
    for way, order in enumerate((range(span), range(span - 1, -1, -1))):
        h = np.zeros((n, UNITS), np.float32)
        w, u = net.inputs[way], net.recurrent[way]
        for t in order:
            z, r = (_squash(w[k][raw[t]] + h @ u[k]) for k in (0, 1))
            a = h @ u[2]
            new = _squash(w[2][raw[t]] + (0.5 + 0.5 * r) * a)
            tapes[way].append((t, h, z, r, new, a))
            h = new + (0.5 + 0.5 * z) * (h - new)
            hidden[way, t] = h
    both = np.concatenate(hidden, axis=2)
    logits = both @ net.out + net.bias
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(n), labels] -= 1
    p /= span * n
    d_out = np.einsum("tnh,tnl->hl", both, p)
    d_hidden = p @ net.out.T
    d_inputs, d_recurrent = [], []
    for way in (0, 1):
        u = net.recurrent[way]
        d_u = [np.zeros_like(x) for x in u]
        dh = np.zeros((n, UNITS), np.float32)
        steps = np.zeros((3, span, n, UNITS), np.float32)
        for t, h, z, r, new, a in reversed(tapes[way]):
            dh = dh + d_hidden[t, :, way * UNITS : (way + 1) * UNITS]
            keep, gate = 0.5 + 0.5 * z, 0.5 + 0.5 * r
            # the softsign's slope is (1 - |value|) squared
            d_new = dh * (1 - keep) * (1 - np.abs(new)) ** 2
            d_z = 0.5 * dh * (h - new) * (1 - np.abs(z)) ** 2
            d_r = 0.5 * d_new * a * (1 - np.abs(r)) ** 2
            d_a = d_new * gate
            steps[:, t] = d_z, d_r, d_new
            dh = dh * keep
            for k, d in enumerate((d_z, d_r, d_a)):
                d_u[k] += h.T @ d
                dh += d @ u[k].T
        hot = np.argsort(raw.ravel(), kind="stable")
        seen, first = np.unique(raw.ravel()[hot], return_index=True)
        d_in = []
        for k in range(3):
            g = np.zeros((256, UNITS), np.float32)
            g[seen] = np.add.reduceat(steps[k].reshape(-1, UNITS)[hot], first)
            d_in.append(g)
        d_inputs += d_in
        d_recurrent += d_u
    return [*d_inputs, *d_recurrent, d_out, p.sum((0, 1))]


def _sampled(texts: pa.Array, seeds: list[int]) -> Iterator[tuple[int, bytes]]:
    """Up to WINDOWS windows of each text, at places drawn over the whole text."""
    raw, ends = utf8(texts)
    for k, seed in enumerate(seeds):
        own = _FOLD[raw[ends[k] : ends[k + 1]]]
        rng = np.random.default_rng(seed & 0xFFFFFFFF)
        most = max(1, min(WINDOWS, len(own) // _TRAIN_SPAN))
        for start in rng.integers(0, max(1, len(own) - _TRAIN_SPAN + 1), most):
            yield k, own[start : start + _TRAIN_SPAN].tobytes().ljust(_TRAIN_SPAN)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Network | None:
    """A network trained on about `sample` documents, an equal quota of each language and one document of each at least; None without any.

    Drawn are rows with a language and a text with a letter, whose crc32(doc_id as text) mod 5 is not 0: of each language those with the smallest hashes
    of id and text, repeated rows once. All rows take part in the draw; only the drawn ones, quota times languages at most, reach the driver, each as WINDOWS windows of _TRAIN_SPAN bytes at places drawn over its whole text.
    """
    body = F.col(text).cast("string")
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id), body).alias("h"), body.alias("text")).where((fold(F.col(doc_id), 5) != 0) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = work_table(rows.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    if not languages:
        return None
    quota = max(1, sample // languages)
    # a threshold leaves a few times the quota of each language, whatever its size; all of a small one
    limit = F.least(F.lit(1.0), (4 * quota + 60) / F.col("n")) * float(1 << 63)
    near = rows.select("lang", "h").join(counts, "lang").where(F.abs(F.col("h").cast("double")) <= limit).select("lang", "h").distinct()
    drawn = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= quota).select("lang", "h")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes = batch.column("lang").to_pylist(), batch.column("h").to_pylist()
            got = list(_sampled(batch.column("text"), hashes))
            yield pa.record_batch([pa.array([hashes[k] for k, _ in got], pa.int64()), pa.array([names[k] for k, _ in got], pa.string()), pa.array([w for _, w in got], pa.binary())], names=["h", "lang", "w"])

    cut = rows.join(F.broadcast(drawn), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).mapInArrow(windows, "h bigint, lang string, w binary")
    got = cut.orderBy("h", "lang", "w").toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {k: i for i, k in enumerate(langs)}
    raw = np.frombuffer(b"".join(got.column("w").to_pylist()), np.uint8).reshape(-1, _TRAIN_SPAN)
    return train(raw, np.array([place[k] for k in names]), langs)


def _pooled(texts: pa.Array, net: Network) -> np.ndarray:
    """Mean probability of each language over all positions of each whole text; zeros for an empty one."""
    raw, ends = utf8(texts)
    n = len(ends) - 1
    counts = -(-np.diff(ends) // SPAN)
    doc = np.repeat(np.arange(n), counts)
    first = np.cumsum(counts) - counts
    start = ends[doc] + (np.arange(len(doc)) - first[doc]) * SPAN
    length = np.minimum(SPAN, ends[doc + 1] - start)
    padded = np.concatenate([_FOLD[raw], np.full(SPAN, 32, np.uint8)])
    total = np.zeros((n, len(net.langs)))
    for lo in range(0, len(doc), 2048):
        own = slice(lo, lo + 2048)
        at = start[own] + np.arange(SPAN)[:, None]
        inside = np.arange(SPAN)[:, None] < length[own]
        window = np.where(inside, padded[at], np.uint8(32))
        sums = np.zeros((window.shape[1], len(net.langs)), np.float32)
        whole = inside.all(1)
        for t, p in net.positions(window):
            sums += p if whole[t] else p * inside[t][:, None]
        for k in range(len(net.langs)):
            total[:, k] += np.bincount(doc[own], sums[:, k], n)
    return total / np.maximum(np.diff(ends), 1)[:, None]


def predict(text: Column, net: Network | None) -> Column:
    """struct<lang, score> of each whole text: the language with the greatest mean probability over all bytes, and that probability. `und` and 0 for a null, a text without letters, and without a network."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = [], []
            for p in pieces(texts):
                raw, ends = utf8(p)
                plain = np.concatenate([[0], np.cumsum(_LETTER[raw])])[ends]
                lettered = np.diff(plain) > 0
                for k in np.flatnonzero(~lettered):
                    lettered[k] = any(map(str.isalpha, p[int(k)].as_py() or ""))
                mean = _pooled(p, net) if net else np.zeros((len(p), 1))
                best = mean.argmax(1)
                ok = lettered & (net is not None)
                langs += [net.langs[b] if y else "und" for b, y in zip(best, ok, strict=True)]
                scores.append(np.where(ok, np.clip(mean[np.arange(len(p)), best], 0, 1), 0.0))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], ["lang", "score"])

    return label(text.cast("string"))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", net: Network | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(own, held_out, lang, score), one row for each row of `docs`: its `columns` (all where None) as a struct and the label of its whole text.

    A null text, one without a letter, and any text without a network is `und` with score 0; of equal probabilities the first language by name is taken. Repeated rows are labelled alike.
    """
    net = fit(docs, text, lang, doc_id) if net is None else net
    labelled = docs.select(packed(docs, columns).alias("own"), (fold(F.col(doc_id), 5) == 0).alias("held_out"), predict(F.col(text), net).alias("p"))
    return labelled.select("own", "held_out", "p.lang", "p.score")
