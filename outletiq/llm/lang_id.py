"""Language ID with interpolated Kneser-Ney character models, one per language.

A text is its words (runs of letters, lower-cased). Each word is scored on its
own, from a boundary symbol through its letters to a closing boundary, so a
distinct word of a batch is scored once. The language with the lowest
cross-entropy per symbol wins.

Training counts character n-grams in Spark over a sample of about
``SAMPLE_CHARS`` characters per language (all rows of a language with fewer);
that also bounds the model, which is the one thing sent to every task. The
sample is drawn by short pieces of text, so lengths of documents do not matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletiq.llm.common import M64, mix, pick, slices, split_words

ORDER = 4
SAMPLE_CHARS = 2_000_000
#: About so many pieces of text make up the sample of a language that has more text than that.
SAMPLE_PIECES = 2_000
#: A piece ends at the first place within so many characters that is not inside a word.
REACH = 256
#: Documents per language, at most about, that calibrate the rejection limit and the score.
CALIBRATION_DOCS = 1_000
#: A document is rejected if its cross-entropy is over what its language and length explain by
#: so many deviations more than for nearly all calibration documents, and also over the entropy
#: of its language's letters without any order (``Model.unordered``), so that a foreign passage
#: or a few codes in a clean document do not count.
REJECT_DEVIATIONS = 4.0
#: Distinct words scored together; bounds a task's memory, changes no result.
WORDS_AT_ONCE = 16_384
UNKNOWN = "und"
GRAMS = "lang string, n int, gram long, context long, suffix long, opens boolean, count long"


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, 0 before, between and after letter runs, and each symbol's word number."""
    text = "\n".join(words).lower()
    lengths = np.fromiter((len(w.lower()) for w in words), np.int64, len(words)) + 1
    cps = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    known, inverse = np.unique(cps, return_inverse=True)
    kind = np.array([unicodedata.category(chr(c))[0] for c in known.tolist()])[inverse]
    at = np.arange(len(cps))
    after_letter = np.maximum.accumulate(np.where(kind == "L", at, -1)) > np.maximum.accumulate(
        np.where((kind == "L") | (kind == "M"), -1, at))
    codes = np.where((kind == "L") | (kind == "M") & after_letter, cps, 0).astype(np.uint64)  # marks follow letters
    owner = np.repeat(np.arange(len(words)), lengths)
    keep = (codes > 0) | np.concatenate([[False], codes[:-1] > 0])  # letters, and one boundary after each run
    return codes[keep], owner[keep]


def _places(codes: np.ndarray) -> np.ndarray:
    """Each symbol's place in its run of letters and closing boundary, from 0."""
    at = np.arange(len(codes))
    opening = np.concatenate([[True], codes[:-1] == 0]) if len(codes) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(opening, at, 0)) if len(codes) else at


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order, the hash of the last n symbols up to and including each position.

    Before the start of a run all symbols are the boundary, so nothing crosses words.
    """
    at, since = np.arange(len(codes)), _places(codes)
    out, h = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64)
    power = np.uint64(1)
    for n in range(1, order + 1):
        back = np.where(since >= n - 1, codes[np.maximum(at - n + 1, 0)], 0)
        h = h + (back + np.uint64(1)) * power  # symbol k places back weighs multiplier ** k
        power = np.uint64(int(power) * 0x9E3779B97F4A7C15 & M64)
        out.append(mix(h + np.uint64(n)))
    return out


def _contexts(grams: list[np.ndarray], codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n - 1 symbols before each position."""
    opening = _places(codes) == 0
    out = []
    for n in range(1, order + 1):
        blank = mix(np.array([sum(pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(n - 1)) + n - 1 & M64], np.uint64))
        before = np.concatenate([blank, grams[n - 1][:-1]])[:len(codes)]
        out.append(np.where(opening, blank if n > 1 else np.uint64(0), before))
    return out


def _gram_rows(texts: pa.Array, langs: list[str], order: int) -> Iterator[pa.RecordBatch]:
    flat, off = split_words(texts)
    words = flat.to_pylist()
    doc_lang = np.repeat(np.arange(len(langs)), np.diff(off))
    names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    word_lang = np.array([names[x] for x in langs], np.int64)[doc_lang] if words else np.zeros(0, np.int64)
    for name, number in names.items():
        codes, _ = _symbols([words[i] for i in np.flatnonzero(word_lang == number).tolist()] or [""])
        grams = _grams(codes, order)
        contexts = _contexts(grams, codes, order)
        shorter = [np.zeros(len(codes), np.uint64), *grams[1:]]
        place = _places(codes)
        for n in range(1, order + 1):
            g, first, count = np.unique(grams[n], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(g), pa.string()), pa.array(np.full(len(g), n, np.int32)),
                 pa.array(g.view(np.int64)), pa.array(contexts[n - 1][first].view(np.int64)),
                 pa.array(shorter[n - 1][first].view(np.int64)), pa.array(place[first] < n - 1),
                 pa.array(count.astype(np.int64))], names=["lang", "n", "gram", "context", "suffix", "opens", "count"])


@dataclass
class Model:
    """Sorted hash arrays, shared by all languages, with one column of values per language.

    ``grams[n]`` holds the hashes of the n-grams seen in any language and
    ``alpha[n]`` their discounted relative counts; ``contexts[n]`` and
    ``weight[n]`` the share that a context passes on to the next shorter one.
    ``unordered`` is the entropy per symbol of each language's own letter
    frequencies; letters of other languages, or rare ones, do not raise it.
    """

    langs: list[str]
    order: int
    symbols: int
    grams: list[np.ndarray]
    alpha: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    unordered: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    sharpness: float = 1.0
    limit: float = np.inf

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of every symbol, a column per language."""
        grams = _grams(codes, self.order)
        contexts = _contexts(grams, codes, self.order)
        p = np.full((len(codes), len(self.langs)), 1.0 / self.symbols, np.float32)
        for n in range(1, self.order + 1):
            p *= _rows(self.contexts[n], self.weight[n], contexts[n - 1], 1.0)
            p += _rows(self.grams[n], self.alpha[n], grams[n], 0.0)
        return np.log(p)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text in each language, and its number of symbols."""
        flat, off = split_words(texts)
        sums = np.zeros((len(flat), len(self.langs)))
        count = np.zeros(len(flat), np.int64)
        if len(flat):
            coded = flat.dictionary_encode()
            own, sizes = self._word_sums(coded.dictionary)
            index = np.asarray(coded.indices)
            sums, count = own[index], sizes[index]
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(sums, axis=0)])
        symbols = np.concatenate([[0], np.cumsum(count)])[off]
        symbols = np.diff(symbols)
        return -(total[off[1:]] - total[off[:-1]]) / np.maximum(symbols, 1)[:, None], symbols

    def _word_sums(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its number of symbols; a part of the words at a time."""
        sums, sizes = np.zeros((len(words), len(self.langs))), np.zeros(len(words), np.int64)
        for a in range(0, len(words), WORDS_AT_ONCE):
            part = words.slice(a, WORDS_AT_ONCE)
            codes, owner = _symbols(part.to_pylist())
            if len(owner):
                sizes[a:a + len(part)] = np.bincount(owner, minlength=len(part))
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                sums[a + owner[first]] = np.add.reduceat(self.log_probs(codes), first, axis=0, dtype=np.float64)
        return sums, sizes

    def deviations(self, entropy: np.ndarray, lang: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """How far a cross-entropy is over the language's mean, in deviations for a text of that length."""
        a, b = self.spread[lang].T
        return (entropy - self.mean[lang]) / np.sqrt(a / np.maximum(symbols, 1) + b)


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing, np.float32)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where((keys[at] == wanted)[:, None], values[at], np.float32(missing))


def build_model(grams: pa.Table, order: int) -> Model:
    """Interpolated Kneser-Ney from gram counts (lang, n, gram, context, suffix, opens, count).

    The longest grams, and grams that begin at a boundary, keep their counts;
    others count the distinct symbols seen before them. Each order has its own
    discount n1 / (n1 + 2 n2) per language.
    """
    langs = sorted(set(grams.column("lang").to_pylist()))
    number = np.searchsorted(langs, grams.column("lang").to_pylist()) if langs else np.zeros(0, np.int64)
    n, opens = np.asarray(grams.column("n")), np.asarray(grams.column("opens"))
    gram, context, suffix = (np.asarray(grams.column(c)).view(np.uint64) for c in ("gram", "context", "suffix"))
    count = np.asarray(grams.column("count")).astype(np.float64)
    symbols = len(np.unique(gram[n == 1])) + 1
    model = Model(langs, order, symbols, *([None] * (order + 1) for _ in range(4)), np.zeros(len(langs)))
    for i in range(len(langs)):
        share = count[(n == 1) & (number == i)]
        share = share / share.sum()
        model.unordered[i] = -(share * np.log(share)).sum()
    for k in range(1, order + 1):
        here = n == k
        keys, at = np.unique(gram[here], return_inverse=True)
        alpha = np.zeros((len(keys), len(langs)), np.float32)
        c_keys, c_at = np.unique(context[here], return_inverse=True)
        weight = np.ones((len(c_keys), len(langs)), np.float32)
        for i in range(len(langs)):
            own = number[here] == i
            c = count[here][own].copy()
            if k < order:  # distinct longer grams that end in this one
                longer = (n == k + 1) & (number == i)
                ends, left = np.unique(suffix[longer], return_counts=True)
                place = np.minimum(np.searchsorted(ends, gram[here][own]), len(ends) - 1)
                seen = np.where(ends[place] == gram[here][own], left[place], 0) if len(ends) else np.zeros(len(c))
                c = np.where(opens[here][own], c, np.maximum(seen, 1))
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(c_at[own], c, len(c_keys))
            followers = np.bincount(c_at[own], minlength=len(c_keys))
            alpha[at[own], i] = (c - discount) / total[c_at[own]]
            used = total > 0
            weight[used, i] = discount * followers[used] / total[used]
        model.grams[k], model.alpha[k], model.contexts[k], model.weight[k] = keys, alpha, c_keys, weight
    return model


def _rate(rates: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]


def _draw(*key: Column | str) -> Column:
    """A number from 0 to 1 by a hash of ``key``."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _sample(rows: DataFrame, rates: dict[str, float], seed: int) -> DataFrame:
    """Rows (doc_id, text, lang) kept by a hash of their id and text, at a rate per language."""
    return rows.where(_draw(F.lit(seed), "doc_id", "text") < _rate(rates)) if rates else rows.limit(0)


def _drawn(rows: DataFrame, rates: dict[str, float], size: int, seed: int) -> DataFrame:
    """(text, lang, pieces) of rows with a drawn piece; ``pieces`` numbers them, and is null where the rate is 1.

    Piece k has the ``size`` characters from k * size on, and is drawn by a hash of its row and number."""
    if not rates:
        return rows.select("text", "lang", F.array().cast("array<long>").alias("pieces")).limit(0)
    row = F.struct(F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), _rate(rates).alias("rate"),
                   F.floor(F.length("text") / F.lit(size)).alias("last"))
    pieces = F.transform(F.array(row), lambda r: F.when(r["rate"] < 1, F.filter(  # the row's hash is taken once
        F.sequence(F.lit(0).cast("long"), r["last"]), lambda k: _draw(r["key"], k) < r["rate"])))[0]
    wanted = rows.where(F.col("lang").isin(*rates))
    return wanted.select("text", "lang", pieces.alias("pieces")).where("pieces is null or size(pieces) > 0")


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` on that is not inside a word; ``at`` itself in a word that goes on for ``REACH``."""
    if not at:
        return 0
    for i in range(at, min(at + REACH, len(text))):
        if unicodedata.category(text[i])[0] not in "LM":
            return i
    return at if at + REACH < len(text) else len(text)


def _cut_pieces(batch: pa.RecordBatch, size: int) -> tuple[list[str], list[str]]:
    """The drawn pieces of (text, lang, pieces) rows, and their languages; whole texts where all is drawn."""
    texts, langs = [], []
    for text, lang, pieces in zip(*(batch.column(c) for c in ("text", "lang", "pieces"))):
        text, pieces = text.as_py(), pieces.as_py()
        own = [text] if pieces is None else [text[_cut(text, k * size):_cut(text, (k + 1) * size)] for k in pieces]
        texts += own
        langs += [lang.as_py()] * len(own)
    return texts, langs


def train(labelled: DataFrame, order: int = ORDER, sample_chars: int = SAMPLE_CHARS,
          calibration_docs: int = CALIBRATION_DOCS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Learn from rows with a language and a text; rows without either are ignored.

    The number of languages is the number of distinct labels; each adds at most about
    ``sample_chars * order`` grams to the model. A language whose sample has no letter
    is learned from all its rows; one without any letter is not in the model.
    """
    rows = pick(labelled, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    totals = rows.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars"), F.count("*").alias("n")).collect()
    size = max(1, sample_chars // SAMPLE_PIECES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", 1 << 20):
                texts, langs = _cut_pieces(b, size)
                yield from _gram_rows(pa.array(texts, pa.large_string()), langs, order)

    def counted(rates: dict[str, float]) -> pa.Table:
        grams = _drawn(rows, rates, size, 1).mapInArrow(count, GRAMS).groupBy("lang", "n", "gram")
        return grams.agg(*[F.first(c).alias(c) for c in ("context", "suffix", "opens")],
                         F.sum("count").alias("count")).toArrow()

    rates = {r.lang: min(1.0, sample_chars / max(r.chars, 1)) for r in totals}
    grams = counted(rates)
    seen = set(grams.column("lang").unique().to_pylist())
    rest = {lang: 1.0 for lang, rate in rates.items() if lang not in seen and rate < 1}
    if rest:
        grams = pa.concat_tables([grams, counted(rest)])
    model = build_model(grams.combine_chunks(), order)
    known = {r.lang: min(1.0, calibration_docs / r.n) for r in totals if r.lang in model.langs}
    return _calibrate(model, _sample(rows, known, 2))


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """Mean and spread of the right language's cross-entropy by length, the rejection limit, and the score's sharpness."""
    k = len(model.langs)
    model.mean, model.spread = np.zeros(k), np.ones((k, 2))
    if not k:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.langs
        for big in batches:
            for b in slices(big, "text", 1 << 20):
                entropy, symbols = shared.value.score(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names.index(x) for x in b.column("lang").to_pylist()], pa.int32()),
                     pa.array(symbols), pa.array(entropy.tolist(), pa.list_(pa.float64()))],
                    names=["lang", "symbols", "entropy"])

    got = rows.mapInArrow(run, "lang int, symbols long, entropy array<double>").where("symbols > 0").toArrow()
    if not got.num_rows:
        return model
    lang, symbols = np.asarray(got.column("lang")), np.asarray(got.column("symbols")).astype(float)
    entropy = np.array(got.column("entropy").to_pylist())
    own = entropy[np.arange(len(lang)), lang]
    right = entropy.argmin(1) == lang
    for i in range(k):
        use = (lang == i) & (right | ~right[lang == i].any())
        if use.any():
            model.mean[i] = np.average(own[use], weights=symbols[use])
            square = (own[use] - model.mean[i]) ** 2
            a = float(np.median(square * symbols[use])) / 0.455  # a chi-square's median: short texts vary by 1 / length
            model.spread[i] = max(a, 1e-3), max(float(np.median(square)) / 0.455, 1e-4)
    z = model.deviations(own, lang, symbols)[right]
    model.limit = max(REJECT_DEVIATIONS, float(np.quantile(z, 0.999)) if len(z) else 0.0) + REJECT_DEVIATIONS
    best = (np.inf, 1.0)
    for sharpness in (1.0, 3.0, 10.0, 30.0, 100.0):
        p = _posterior(entropy, symbols, sharpness)[np.arange(len(lang)), lang]
        best = min(best, (float(-np.log(np.maximum(p, 1e-9)).mean()), sharpness))
    model.sharpness = best[1]
    return model


def _posterior(entropy: np.ndarray, symbols: np.ndarray, sharpness: float) -> np.ndarray:
    """Softmax of the cross-entropies; short texts count for less."""
    scale = sharpness * np.minimum(1.0, np.sqrt(symbols / 50.0))
    x = -(entropy - entropy.min(1, keepdims=True)) * scale[:, None]
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


def _judge(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy (NaN if unknown) and rejection of each text."""
    n = len(texts)
    entropy, symbols = m.score(texts) if m.langs else (np.zeros((n, 1)), np.zeros(n, np.int64))
    best, known = entropy.argmin(1), symbols > 0
    least = entropy[np.arange(n), best]
    score = np.where(known, _posterior(entropy, symbols, m.sharpness)[np.arange(n), best], 0.0)
    names = np.array([*m.langs, UNKNOWN], object)[np.where(known, best, len(m.langs))]
    rejected = ~known
    if m.langs:
        rejected |= (least > m.unordered[best]) & (m.deviations(least, best, symbols) > m.limit)
    return names, score, np.where(known, least, np.nan), rejected


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row, from its text alone.

    ``lang_pred`` is ``und`` with score 0 and rejected if a text is null or has
    no letter, or if nothing was learned. ``rejected`` also marks texts whose
    cross-entropy is far above that of any text of the language at that length,
    and above that of the language's letters in no order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", 1 << 20):
                names, score, entropy, rejected = _judge(shared.value, b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score),
                     pa.array(entropy, from_pandas=True), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Documents whose language is recognised, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, place, 1 << 20):
                yield b.filter(pa.array(~_judge(shared.value, b.column(place))[3]))

    return docs.mapInArrow(run, docs.schema)


def fold(c: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(n))


def learn_and_predict(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows outside fold 0 and predicts all rows; ``held_out`` marks fold 0.

    A row without an id is in no fold: it is not learned from, and not marked."""
    model = train(docs.where(fold("doc_id", folds) != 0))
    held_out = F.coalesce(fold("doc_id", folds) == 0, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy",
                                       "rejected")
