"""Language-model scores: the likelihood of a text over all its segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import fold, utf8, work_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The most frequent words that every task holds; all other words are joined.
HEAD = 100_000
_LOG10 = math.log(10)


@dataclass
class Pieces:
    """A vocabulary as byte strings with natural-log probabilities. A word is scored with a blank before it, as the pieces are written."""

    names: list[bytes]
    logp: np.ndarray
    end: float = math.log(1e-3)

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """next[inner node, byte] and the piece of each node (-1: none). Inner nodes come first; -1 is a dead end."""
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, name in enumerate(self.names):
            node = 0
            for b in name:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = k
        order = sorted(range(len(children)), key=lambda n: not children[n])
        place = {n: i for i, n in enumerate(order)}
        inner = sum(map(bool, children))
        step = np.full((inner, 256), -1, np.int32)
        for n in order[:inner]:
            for b, child in children[n].items():
                step[place[n], b] = place[child]
        return step, np.array([ends[n] for n in order], np.int32)


def load(path: str = VOCABULARY) -> Pieces:
    """The pieces of a SentencePiece file. Their scores are ranks there; a piece of rank r starts with a probability in proportion to 1 / (r + 3).

    Bytes that the vocabulary has as a character and as a byte piece count once, under the better rank, so that every text has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        name = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        rank = model.get_piece_size() if model.is_byte(i) else -model.get_score(i)
        best[name] = min(best.get(name, math.inf), rank)
    for b in range(256):
        best.setdefault(bytes([b]), model.get_piece_size())
    names = sorted(best)
    weight = np.array([1 / (max(0.0, best[n]) + 3) for n in names])
    return Pieces(names, np.log(weight / weight.sum()))


def _same_length(words: list[bytes], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and byte rows, with a blank before them, of words of one length at a time."""
    length = np.array([len(w) for w in words])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        rows = max(1, most // (int(n) + 1))
        for lo in range(0, len(at), rows):
            own = at[lo : lo + rows]
            yield own, np.frombuffer(b"".join(b" " + words[k] for k in own), np.uint8).reshape(len(own), n + 1)


def _edges(raw: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, rows, piece) of all vocabulary pieces in words of one length, by start."""
    step, ends = pieces.trie
    inner = len(step)
    for i in range(raw.shape[1]):
        rows = np.arange(len(raw))
        node = np.zeros(len(raw), np.int32)
        for j in range(i, raw.shape[1]):
            node = step[node, raw[rows, j]]
            live = node >= 0
            rows, node = rows[live], node[live]
            if not len(rows):
                break
            piece = ends[node]
            found = piece >= 0
            if found.any():
                yield i, j + 1, rows[found], piece[found]
            deeper = node < inner
            rows, node = rows[deeper], node[deeper]
            if not len(rows):
                break


def _forward(raw: np.ndarray, pieces: Pieces, kept: list | None = None) -> np.ndarray:
    alpha = np.full((raw.shape[1] + 1, len(raw)), -np.inf)
    alpha[0] = 0
    for i, j, rows, piece in _edges(raw, pieces):
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + pieces.logp[piece])
        if kept is not None:
            kept.append((i, j, rows, piece))
    return alpha


#: Words from this length on are taken one by one, all their positions at once.
LONG = 512


def _lattice(word: bytes, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, piece) of all vocabulary pieces in one word, by start."""
    raw = np.frombuffer(b" " + word, np.uint8)
    step, ends = pieces.trie
    at = np.arange(len(raw))
    node, out = np.zeros(len(raw), np.int32), []
    for k in range(len(raw)):
        # all starts go one byte deeper at a time, until no piece is long enough
        inside = (at + k < len(raw)) & (node < len(step))
        at, node = at[inside], node[inside]
        node = step[node, raw[at + k]]
        at, node = at[node >= 0], node[node >= 0]
        if not len(at):
            break
        found = ends[node] >= 0
        out.append(np.column_stack([at[found], at[found] + k + 1, ends[node[found]]]))
    edges = np.concatenate(out)
    return tuple(edges[np.lexsort((edges[:, 1], edges[:, 0]))].T)


def _chain(n: int, tail: np.ndarray, head: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The log sum over all paths of edges tail -> head (sorted by tail) to each of n + 1 places from place 0."""
    sums, scale = [0.0] * (n + 1), [-math.inf] * (n + 1)
    sums[0], scale[0] = 1.0, 0.0
    # the sums stay near 1: each place holds a factor and its logarithmic scale
    for i, j, p in zip(tail.tolist(), head.tolist(), logp.tolist(), strict=True):
        if not sums[i]:
            continue
        x = scale[i] + math.log(sums[i]) + p
        if x <= scale[j]:
            sums[j] += math.exp(x - scale[j])
        else:
            sums[j] = sums[j] * math.exp(scale[j] - x) + 1.0 if sums[j] else 1.0
            scale[j] = x
    return np.array(scale) + np.log(np.maximum(sums, 1e-300))


def log_marginals(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """The natural log of each word's probability, summed over all its segmentations by a forward recursion in log space."""
    out = np.zeros(len(words))
    short = [k for k, w in enumerate(words) if len(w) < LONG]
    for at, raw in _same_length([words[k] for k in short]):
        out[np.array(short)[at]] = _forward(raw, pieces)[-1]
    for k in (k for k, w in enumerate(words) if len(w) >= LONG):
        i, j, piece = _lattice(words[k], pieces)
        out[k] = _chain(len(words[k]) + 1, i, j, pieces.logp[piece])[-1]
    return out


def expected_pieces(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in `counts` of each word, over all segmentations."""
    out = np.zeros(len(pieces.names))
    short = [k for k, w in enumerate(words) if len(w) < LONG]
    for at, raw in _same_length([words[k] for k in short]):
        kept: list = []
        alpha = _forward(raw, pieces, kept)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for i, j, rows, piece in reversed(kept):
            beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + pieces.logp[piece])
        n = counts[np.array(short)[at]]
        for i, j, rows, piece in kept:
            np.add.at(out, piece, n[rows] * np.exp(alpha[i, rows] + pieces.logp[piece] + beta[j, rows] - alpha[-1, rows]))
    for k in (k for k, w in enumerate(words) if len(w) >= LONG):
        i, j, piece = _lattice(words[k], pieces)
        n, logp = len(words[k]) + 1, pieces.logp[piece]
        alpha = _chain(n, i, j, logp)
        back = np.lexsort((-i, -j))
        beta = _chain(n, n - j[back], n - i[back], logp[back])[::-1]
        np.add.at(out, piece, counts[k] * np.exp(alpha[i] + logp + beta[j] - alpha[-1]))
    return out


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame, text: str, train: str, most: int = 400_000) -> DataFrame:
    """(word, c) of all distinct words of all texts, c counted where `train` holds; pre-aggregated in each task, `most` words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train_words: Counter[bytes] = Counter()
        held: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            only = [w for w in held if w not in train_words]
            words = [*train_words, *only]
            batch = pa.record_batch([pa.array(words, pa.binary()), pa.array([*train_words.values(), *repeat(0, len(only))], pa.int64())], names=["word", "c"])
            train_words.clear()
            held.clear()
            return batch

        for batch in batches:
            raw, ends = utf8(batch.column("text"))
            data = raw.tobytes()
            for own, lo, hi in zip(batch.column("train").to_pylist(), ends[:-1], ends[1:], strict=True):
                (train_words if own else held).update(_tokens(data[lo:hi]))
                if len(train_words) + len(held) > most:
                    yield flush()
        yield flush()

    narrow = docs.select(F.col(text).cast("string").alias("text"), F.col(train).alias("train"))
    return narrow.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, n_ends: int, pieces: Pieces, rounds: int = 2, prior: float = 1000.0) -> Pieces:
    """Piece probabilities re-estimated on the training words by `rounds` of expectation maximisation, from the vocabulary's own.

    The vocabulary stays as it is; `prior` occurrences are shared out by its own probabilities, so no piece has none. The end of a text is an event beside the pieces.
    """
    existing = np.exp(pieces.logp)
    for _ in range(rounds):
        model = pieces

        def expect(batches: Iterator[pa.RecordBatch], model: Pieces = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.names))
            for batch in batches:
                total += expected_pieces(batch.column("word").to_pylist(), batch.column("c").to_numpy(), model)
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], names=["piece", "n"])

        rows = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = prior * existing
        for r in sorted(rows):
            n[r["piece"]] += r["n"]
        total = n.sum() + n_ends + 1
        pieces = Pieces(model.names, np.log(n / total), math.log((n_ends + 1) / total))
    return pieces


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, head: int = HEAD, rounds: int = 2) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2. The base is an add-one unigram model of words; `score` is the log10
    probability of the whole text as words, each the sum over all its segmentations, and an end. A null text counts as empty: its only
    token is the end. Without any training row, N and V are 0 and the pieces keep the vocabulary's own probabilities. Repeated rows count and are scored one by one.

    Each distinct word is scored once. The `head` most frequent ones, a bounded number, go to every task; a document's other words are joined to the table of words.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (fold(F.col(doc_id), 7) == 2).alias("held_out")).withColumn("train", ~F.col("held_out"))
    counted = work_table(word_counts(marked, "text", "train"))
    n_docs = marked.where("train").count()
    n_words, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_train, n_distinct = n_words + n_docs, distinct + (n_docs > 0)
    pieces = fit(counted, n_docs, load(vocabulary), rounds)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(log_marginals(batch.column("word").to_pylist(), pieces) / _LOG10)], names=["word", "c", "lp"])

    words = work_table(counted.mapInArrow(marginal, "word binary, c bigint, lp double"))
    top = words.orderBy(F.desc("c"), "word").limit(head).toArrow()
    shared = spark.sparkContext.broadcast((dict(zip(top.column("word").to_pylist(), range(top.num_rows), strict=True)), top.column("c").to_numpy(), top.column("lp").to_numpy()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c, lp = shared.value
        c, lp = np.append(c, 0), np.append(lp, 0.0)
        log_c = np.log10(c + 1.0)
        for whole in batches:
            for batch in _slices(whole):
                raw, ends = utf8(batch.column("text"))
                data = raw.tobytes()
                n, known, base, total, rest = [], [], [], [], []
                for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                    tokens = _tokens(data[lo:hi])
                    at = np.fromiter(map(place.get, tokens, repeat(len(place))), np.int64, len(tokens))
                    n.append(len(tokens))
                    known.append(int((c[at] > 0).sum()))
                    base.append(float(log_c[at].sum()))
                    total.append(float(lp[at].sum()))
                    rest.append(list(Counter(map(tokens.__getitem__, np.flatnonzero(at == len(place)))).items()))
                each = pa.array([len(r) for r in rest], pa.int64()).to_numpy()
                offsets = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
                pairs = [x for r in rest for x in r]
                items = pa.StructArray.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([k for _, k in pairs], pa.int64())], ["word", "n"])
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.ListArray.from_arrays(offsets, items)], names=["doc_id", "held_out", "n", "known", "base", "total", "rest"])

    kind = dict(marked.dtypes)["doc_id"]
    near = marked.select("doc_id", "held_out", "text").mapInArrow(look_up, f"doc_id {kind}, held_out boolean, n bigint, known bigint, base double, total double, rest array<struct<word: binary, n: bigint>>")
    near = work_table(near.withColumn("row", F.monotonically_increasing_id()))
    far = near.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(words, "word")
    far = far.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("base2"), F.sum(F.col("n") * F.col("lp")).alias("total2"))
    none = F.lit(0.0)
    size = F.lit(math.log10(n_train + n_distinct + 1))
    return near.drop("rest").join(far, "row", "left").select(
        "doc_id", "held_out", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("known2", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", none) + math.log10(n_docs + 1) - (F.col("n") + 1) * size).alias("base_score"), (F.col("total") + F.coalesce("total2", none) + pieces.end / _LOG10).alias("score"),
    )


def _slices(batch: pa.RecordBatch, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    _, ends = utf8(batch.column("text"))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most_bytes, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
