"""Quality rules by distribution divergence from language references."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import packed, pieces, scratch, work_table
from dirlake.llm.textstats import CLASSES, Texts, class_counts, repeated_lines, repeated_words, symbol_counts, word_chars

#: Common words whose shares make up the word histogram; one more bin holds all other words.
COMMON = {
    "en": "the of and to in a is that it for on was be with as by at this from are an not or have he",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus er",
    "fr": "le la les de des et un une du en que qui dans pour par sur est au il ce pas plus ne se avec",
    "es": "el la los las de y que en un una del se por con no su para es al lo como más o pero sus",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
N_CHAR, N_WORD = len(CLASSES), len(WORDS) + 1
#: Languages whose references are held and scored at once.
BLOCK = 500

_BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BASE = ", ".join(f"{f}: bigint" for f in _BASE_FIELDS)
_STATS = f"{_BASE}, chars: array<int>, common: array<int>"
_NEAREST = "ref: string, char_jsd: double, word_jsd: double"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), x.shape[1]).cast(pa.list_(pa.int32()))


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    h = Texts.of(pa.array(WORDS)).words()
    order = np.argsort(h)
    return h[order], order


def _stats(texts: pa.Array, known: np.ndarray, bins: np.ndarray) -> pa.Array:
    t = Texts.of(texts, lower=True)
    bare = np.where((t.stops - t.starts > 1) & np.isin(t.raw[np.maximum(t.stops - 1, 0)], [44, 46, 59, 58]), t.stops - 1, t.stops) if len(t.starts) else t.stops
    h = t.hashes(t.starts, bare)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    slot = np.where(known[at] == h, bins[at], len(WORDS))
    common = np.bincount(t.doc * N_WORD + slot, minlength=len(t.n_words) * N_WORD).reshape(-1, N_WORD)
    exact = Texts.of(texts)
    base = (t.n_words, word_chars(t), symbol_counts(t), repeated_lines(exact), repeated_words(exact, exact.words()))
    return pa.StructArray.from_arrays([*(pa.array(x.astype(np.int64)) for x in base), _lists(class_counts(t)), _lists(common)], [*_BASE_FIELDS, "chars", "common"])


def _measure(texts: pa.Array, known: np.ndarray, bins: np.ndarray) -> pa.Array:
    done = [_stats(x, known, bins) for x in pieces(texts)]
    return pa.concat_arrays(done) if done else _stats(texts, known, bins)


def text_stats(text: Column) -> Column:
    """A struct of the base counts and both histograms of each whole text; a null text counts as empty."""

    @F.arrow_udf(f"struct<{_STATS}>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, bins = _common_hashes()
        for texts in batches:
            yield _measure(texts, known, bins)

    return stats(text.cast("string"))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", columns: Sequence[str] | None = None) -> DataFrame:
    """Work table (row, own, lang, s), a row for each row of `docs`: a key, its `columns` (all where None) as a struct, its language, and the statistics of its whole text. All that follows reads the statistics from here."""
    return work_table(docs.select(F.monotonically_increasing_id().alias("row"), packed(docs, columns).alias("own"), F.col(lang).cast("string").alias("lang"), text_stats(F.col(text)).alias("s")))


def language_histograms(rows: DataFrame) -> DataFrame:
    """Work table (lang, n, c0, c1, ..., w0, w1, ...): both histograms summed over all rows (lang, s) of each language that has words. Rows without a language are in none."""
    sums = [F.sum(F.col("s.chars")[i]).alias(f"c{i}") for i in range(N_CHAR)] + [F.sum(F.col("s.common")[i]).alias(f"w{i}") for i in range(N_WORD)]
    return work_table(rows.where("lang is not null").groupBy("lang").agg(F.sum("s.n_words").alias("n"), *sums).where("n > 0"))


def blocks(histograms: DataFrame, most: int = BLOCK) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The languages of `histograms` in the order of their names, `most` at a time; the driver holds one block."""
    rest = histograms
    while True:
        rows = rest.orderBy("lang").limit(most).collect()
        if rows:
            yield {r["lang"]: (np.array([r[f"c{i}"] for i in range(N_CHAR)], float), np.array([r[f"w{i}"] for i in range(N_WORD)], float)) for r in rows}
        if len(rows) < most:
            return
        rest = histograms.where(F.col("lang") > rows[-1]["lang"])


def fit_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The references of all languages at once, for few of them; `judge` takes them by blocks."""
    return {k: v for block in blocks(language_histograms(measured(docs, text, lang, []))) for k, v in block.items()}


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of each row of `p` from `q`; 0 for an empty row."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    q = q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(p.sum(1) > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def _rows(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def _nearest(s: pa.Array, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    names = sorted(refs)
    if not names:
        return pa.array([None] * len(s), pa.struct([("ref", pa.string()), ("char_jsd", pa.float64()), ("word_jsd", pa.float64())]))
    chars, common = _rows(s.field("chars"), N_CHAR), _rows(s.field("common"), N_WORD)
    best, least = np.zeros(len(s), np.int64), np.full((2, len(s)), np.inf)
    for i, k in enumerate(names):
        own = np.array([jensen_shannon(chars, refs[k][0]), jensen_shannon(common, refs[k][1])])
        less = own.sum(0) < least.sum(0)
        best[less], least[:, less] = i, own[:, less]
    return pa.StructArray.from_arrays([pa.array([names[b] for b in best], pa.string()), pa.array(least[0]), pa.array(least[1])], ["ref", "char_jsd", "word_jsd"])


def divergence(stats: Column, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> Column:
    """struct<ref, char_jsd, word_jsd>: the reference with the least sum of both distances; null without references."""

    @F.arrow_udf(f"struct<{_NEAREST}>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            yield _nearest(s, refs)

    return score(stats)


def base_and_divergence(text: Column, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> Column:
    """A struct of the base counts of each whole text and `d`, its divergence. One function, so that a task has one Python worker and the histograms stay in it."""

    @F.arrow_udf(f"struct<{_BASE}, d: struct<{_NEAREST}>>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, bins = _common_hashes()
        for texts in batches:
            s = _measure(texts, known, bins)
            yield pa.StructArray.from_arrays([*(s.field(f) for f in _BASE_FIELDS), _nearest(s, refs)], [*_BASE_FIELDS, "d"])

    return both(text.cast("string"))


def _near(rows: DataFrame, refs: dict | None, most: int) -> DataFrame:
    """`rows` with `d`, the divergence of each from its nearest reference. Beyond one block of languages each block passes once over a narrow work table and keeps the nearer reference."""
    parts = iter([refs]) if refs is not None else blocks(language_histograms(rows), most)
    first, more = next(parts, {}), next(parts, None)
    if more is None:
        return rows.withColumn("d", divergence(F.col("s"), first))
    near = work_table(rows.select("row", "s", divergence(F.col("s"), first).alias("d")))
    while more is not None:
        both = near.withColumn("e", divergence(F.col("s"), more))
        # blocks come by name, so that a tie stays with the first name
        less = F.col("e.char_jsd") + F.col("e.word_jsd") < F.col("d.char_jsd") + F.col("d.word_jsd")
        near = work_table(both.select("row", "s", F.when(less, F.col("e")).otherwise(F.col("d")).alias("d")))
        more = next(parts, None)
    return rows.select("row", "own").join(near, "row")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", max_char: float = 0.21, max_word: float = 0.27, far_char: float = 0.35, min_chars: int = 250, min_words: int = 40, refs: dict | None = None, most: int = BLOCK, columns: Sequence[str] | None = None) -> DataFrame:
    """(own, q), one row for each row of `docs`: its `columns` (all where None) as a struct, and a struct of the base counts, `base_failed`, the distances and `kept`.

    A document goes if it fails the base rules (under 10 words, or over 20 % of its words in repeated five-word
    windows) or if it is far from every language reference: its character-class distance is above `max_char` and
    its common-word distance above `max_word`, or its character-class distance alone is above `far_char`. The
    first needs `min_words` words, both need `min_chars` characters in words, since histograms of shorter texts
    say little. Null and empty texts have no words and fail; without any reference only the base rules
    count. Repeated rows are judged one by one, alike. Of references at one distance the first by name is reported. Every language has a reference; `most` of them are scored at once.
    """
    out = _near(measured(docs, text, lang, columns), refs, most)
    limits = {"max_char": max_char, "max_word": max_word, "far_char": far_char, "min_chars": min_chars, "min_words": min_words}
    return out.select("own", verdict(F.col("s"), F.col("d"), **limits).alias("q"))


def verdict(s: Column, d: Column, max_char: float = 0.21, max_word: float = 0.27, far_char: float = 0.35, min_chars: int = 250, min_words: int = 40) -> Column:
    """The struct `q` of `judge` from a text's statistics and its divergence."""
    char, word = F.coalesce(d["char_jsd"], F.lit(0.0)), F.coalesce(d["word_jsd"], F.lit(0.0))
    failed = (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)
    far = (s.word_chars >= min_chars) & (((s.n_words >= min_words) & (char > max_char) & (word > max_word)) | (char > far_char))
    return F.struct(*(s[f].alias(f) for f in _BASE_FIELDS), failed.alias("base_failed"), d["ref"].alias("ref"), char.alias("char_jsd"), word.alias("word_jsd"), (~failed & ~far).alias("kept"))


def keep_good(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """The rows and columns of `docs` that the rules keep, repeated rows as often as they come; null and empty texts go.

    Only statistics are stored, for the references. With one block of languages texts are measured again where they pass by, rather than written once more.
    """
    with scratch():
        parts = blocks(language_histograms(measured(docs, columns=[])), most)
        first, more = next(parts, {}), next(parts, None)
    if more is not None:
        return judge(docs, most=most).where("q.kept").select("own.*")
    near = docs.select(packed(docs).alias("own"), base_and_divergence(F.col("text"), first).alias("s"))
    return near.where(verdict(F.col("s"), F.col("s.d"))["kept"]).select("own.*")
