"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text's letters are scored word by word; a word is a run of lower-cased letters between two boundary marks, so the
distinct words of a batch are scored once. One sorted array of 64-bit n-gram hashes serves all languages: beside each hash
stand, for each language, the interpolated log2 probability of the n-gram's last character and the
back-off weight of the n-gram as a context. The language with the least cross-entropy a character wins. Rows that are kept out of the fit calibrate
the rest: how far a language's own texts of a given length lie from its mean entropy sets the bound above which a text is rejected, and the
temperature of the scores is the one under which their languages are likeliest.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm.shared import held, written
from infospan.llm.tokens import slices

UNKNOWN = "und"
ORDER = 5
#: Rows of each language at most that the model is fitted on and that calibrate it, chosen by hashes of the id; the model's size follows this, not the corpus.
TRAINING_ROWS, CALIBRATION_ROWS = 500, 250
#: Share of a language's texts that may lie above its rejection bound, whatever their distribution (Cantelli's inequality).
REJECTED_SHARE = 0.002
#: Temperatures tried for the score.
TEMPERATURES = tuple(2.0**-k for k in range(16))
#: Words whose bits a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Bytes of text scored at once.
TEXT_AT_ONCE = 2_000_000
#: New words scored at once: a bound on the score matrices, which have a row for each character.
WORDS_AT_ONCE = 20_000
BOUNDARY = 0x110000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> pa.Array:
    """The runs of letters and combining marks of each text, lower-cased; null: none."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.ascii_split_whitespace(pc.replace_substring_regex(lower, r"[^\pL\pM]+", " "))


def letters_of(words: list[str]) -> list[str]:
    """Lower-cased letters of each word in NFC; other characters are dropped."""
    return [w.lower() if w.isalpha() and w.isascii() else "".join(filter(str.isalpha, unicodedata.normalize("NFC", w).lower())) for w in words]


def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes) * PRIME
    return h ^ (h >> np.uint64(29))


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character to predict (letters, then the closing boundary): its word and the hashes of the 1- to order-grams that end there.

    Row n of the hashes is 0 where the word hasn't n characters up to there; a word begins with one boundary mark.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    full = np.full(int(lengths.sum()) + 2 * len(words), BOUNDARY, np.uint64)
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    inside = np.repeat(starts + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(codes))
    full[inside] = codes
    place = np.arange(len(full)) - np.repeat(starts, lengths + 2)
    word = np.repeat(np.arange(len(words)), lengths + 2)
    hashes = np.zeros((order + 1, len(full)), np.uint64)
    for n in range(1, order + 1):
        # An n-gram's hash goes from its last character back to its first, so that its suffixes are the rows before.
        h = np.full(len(full), np.uint64(n))
        for back in range(min(n, len(full))):
            h[back:] = _mix(h[back:], full[: len(full) - back]) if back else _mix(h, full)
        h[place < n - 1] = 0
        hashes[n] = h
    keep = place > 0
    return word[keep], hashes[:, keep], np.flatnonzero(keep)


def gram_hashes(listed: list[str]) -> np.ndarray:
    """The hashes of n-grams of one size, as grams() makes them; a line end stands for a boundary mark."""
    if not listed:
        return np.zeros(0, np.uint64)
    size = len(listed[0])
    codes = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, size)
    codes[codes == ord("\n")] = BOUNDARY
    h = np.full(len(listed), np.uint64(size))
    for k in range(size - 1, -1, -1):
        h = _mix(h, codes[:, k])
    return h


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order: sorted hashes
    logp: list[np.ndarray]  # by order: (keys, languages), interpolated log2 probability; NaN if unseen in the language
    backoff: list[np.ndarray]  # by order: (keys, languages), log2 weight of the lower order after this context; 0 if unseen
    floor: np.ndarray  # log2 probability of a character never seen
    bounds: np.ndarray  # (languages, 3): mean entropy of the language's texts, the part of its variance that stays and the one that falls with 1 / characters
    temperature: float
    name: str

    def limit(self, language: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The highest cross-entropy a character at which texts of these languages and lengths aren't rejected."""
        mean, stays, falls = self.bounds[language].T
        return mean + np.sqrt((1 / REJECTED_SHARE - 1) * (stays + falls / np.maximum(1, chars)))

    def cross_entropy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word by each language, and its number of characters (with the closing boundary)."""
        n_langs = len(self.languages)
        if not words:
            return np.zeros((0, n_langs)), np.zeros(0, np.int64)
        order = len(self.keys)
        word, hashes, _ = grams(words, order)
        logp = np.tile(self.floor, (len(word), 1))
        # Contexts are the grams one character back: the hash row of the position before.
        before = np.zeros_like(hashes)
        before[:, 1:] = hashes[:, :-1]
        first = np.concatenate(([True], word[1:] != word[:-1]))
        opening = gram_hashes(["\n"])[0]
        before[:, first] = 0
        before[1, first] = opening
        for n in range(1, order + 1):
            if n > 1:
                weight = self._rows(self.backoff[n - 2], self.keys[n - 2], before[n - 1], 0.0)
                logp += weight
            seen = self._rows(self.logp[n - 1], self.keys[n - 1], hashes[n], np.nan)
            logp = np.where(np.isnan(seen), logp, seen)
        bits = np.stack([np.bincount(word, -logp[:, k], len(words)) for k in range(n_langs)], axis=1)
        return bits, np.bincount(word, minlength=len(words))

    @staticmethod
    def _rows(values: np.ndarray, keys: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(wanted), values.shape[1]), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], values[at], missing)


def _gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): all 2- to order-grams of the rows' words, characters as one string; partial sums in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            for part in slices(batch, 1, TEXT_AT_ONCE):
                for lang in pc.unique(part.column(0)).to_pylist():
                    texts = part.column(1).filter(pc.equal(part.column(0), lang))
                    counted = pc.value_counts(words_of(texts).flatten())
                    for word, n in zip(letters_of(counted.field(0).to_pylist()), counted.field(1).to_pylist(), strict=True):
                        if word:
                            marked = "\n" + word + "\n"
                            for size in range(2, order + 1):
                                for i in range(len(marked) - size + 1):
                                    total[lang, marked[i : i + size]] += n
                            for i in range(1, len(marked)):
                                total[lang, marked[i]] += n
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: dict[str, dict[str, int]], order: int) -> Model:
    """Interpolated Kneser-Ney models with one discount for each order, n1 / (n1 + 2 n2).

    The highest order uses plain counts, lower ones the number of distinct characters before; grams that begin a word
    keep plain counts, as nothing stands before them.
    """
    languages = sorted(counts)
    logs: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.full(len(languages), np.nan)) for _ in range(order)]
    weights: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(languages))) for _ in range(order)]
    floor = np.zeros(len(languages))
    alphabet = len({g for c in counts.values() for g in c if len(g) == 1}) + 1
    for k, lang in enumerate(languages):
        by_size: list[dict[str, int]] = [{} for _ in range(order + 1)]
        for gram, n in counts[lang].items():
            by_size[len(gram)][gram] = n
        for size in range(1, order):
            follows: dict[str, int] = defaultdict(int)
            for gram in by_size[size + 1]:
                follows[gram[1:]] += 1
            by_size[size] = {g: n if g[0] == "\n" and size > 1 else follows.get(g, 0) or n for g, n in by_size[size].items()}
        prob: dict[str, float] = {}
        for size in range(1, order + 1):
            grams_here = by_size[size]
            once, twice = sum(n == 1 for n in grams_here.values()), sum(n == 2 for n in grams_here.values())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for gram, n in grams_here.items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            for context, n in total.items():
                weight = discount * kinds[context] / n
                if context:
                    weights[size - 2][context][k] = np.log2(weight)
                else:
                    base = weight / alphabet
                    floor[k] = np.log2(base)
            here: dict[str, float] = {}
            for gram, n in grams_here.items():
                context = gram[:-1]
                lower = prob.get(gram[1:], base) if size > 1 else 1 / alphabet
                here[gram] = (n - discount) / total[context] + discount * kinds[context] / total[context] * lower
                logs[size - 1][gram][k] = np.log2(here[gram])
            prob |= here
    keys, logp, backoff = [], [], []
    for size in range(order):
        listed = list(logs[size] | weights[size])  # with contexts that are no grams themselves
        hashes = gram_hashes(listed)
        order_of = np.argsort(hashes)
        keys.append(hashes[order_of])
        logp.append(np.array([logs[size][g] for g in listed]).reshape(-1, len(languages))[order_of])
        backoff.append(np.array([weights[size][g] for g in listed]).reshape(-1, len(languages))[order_of])
    return Model(languages, keys, logp, backoff, floor, np.tile([np.inf, 0.0, 0.0], (len(languages), 1)), 1.0, uuid.uuid4().hex)


class WordBits:
    """The bits of the distinct words that a worker has met, by each language."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.bits, self.chars = np.zeros((1 << 16, len(self.model.languages)), np.float32), np.zeros(1 << 16, np.int32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Where each distinct word's bits and characters stand."""
        if len(self.at) + len(words) > REMEMBERED:
            self.clear()
        new = [w for w in words if w not in self.at]
        first = len(self.at)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))
        while len(self.at) > len(self.chars):
            self.bits, self.chars = np.concatenate([self.bits, np.zeros_like(self.bits)]), np.concatenate([self.chars, np.zeros_like(self.chars)])
        letters = letters_of(new)
        some = [i for i, w in enumerate(letters) if w]
        for i in range(0, len(some), WORDS_AT_ONCE):
            part = np.array(some[i : i + WORDS_AT_ONCE])
            self.bits[first + part], self.chars[first + part] = self.model.cross_entropy([letters[j] for j in part.tolist()])
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text by each language and its number of characters; 0 characters if it has no letter."""
        lists = words_of(texts)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        total = np.stack([np.bincount(text, self.bits[at, k], len(texts)) for k in range(self.bits.shape[1])], axis=1)
        return total, np.bincount(text, self.chars[at], len(texts)).astype(np.int64)


def word_bits(model: Model) -> WordBits:
    return held(model.name, lambda: WordBits(model))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """(lang, text, h) of about `rows` rows of each language at most, by a hash of the id; all where there are fewer."""
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).where("lang is not null")
    share = {r["lang"]: min(1.0, rows / r["n"]) for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return named.limit(0)
    # All 63 bits of the hash, as a language may have far more than a million times `rows` documents.
    cut = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(min((1 << 63) - 1, int(v * (1 << 63)))))])
    return named.where(F.shiftrightunsigned("h", 1) <= cut[F.col("lang")]).where("text is not null")


def spread(entropy: np.ndarray, chars: np.ndarray) -> tuple[float, float, float]:
    """Mean of the entropies, and what of their variance stays in the longer half of the texts and what falls with 1 / characters in the others."""
    mean = float(np.average(entropy, weights=chars))
    off, long = (entropy - mean) ** 2, chars >= np.median(chars)
    stays = float(off[long].mean())
    falls = float(np.maximum(0, (off - stays) * chars)[~long].mean()) if not long.all() else 0.0
    return mean, stays, falls


def calibrate(model: Model, own: np.ndarray, bits: np.ndarray, chars: np.ndarray) -> None:
    """Sets the model's bounds and temperature by rows of known language `own`; a language without one rejects nothing."""
    for k in np.unique(own):
        mine = own == k
        model.bounds[k] = spread(bits[mine, k] / chars[mine], chars[mine])
    if len(own):
        behind = bits - bits[np.arange(len(own)), own][:, None]
        loss = [np.logaddexp2.reduce(-t * behind, axis=1).sum() for t in TEMPERATURES]
        model.temperature = TEMPERATURES[int(np.argmin(loss))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, rows: int = TRAINING_ROWS, held_out: int = CALIBRATION_ROWS) -> Model:
    """Fits the models on a bounded sample (`rows` a language) of the rows with a language and calibrates them on `held_out` others.

    Rows that agree in id are in one of the two samples. Null languages and texts teach nothing.
    """
    sample = written(training_rows(docs, id_col, text_col, lang_col, rows + held_out), "language-sample")
    kept_out = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(rows + held_out)) < held_out
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in _gram_counts(sample.where(~kept_out), order).collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    if not counts:
        return Model([], [], [], [], np.zeros(0), np.zeros((0, 3)), 1.0, uuid.uuid4().hex)
    model = kneser_ney(counts, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_bits(shared.value)
        for batch in batches:
            for part in slices(batch, 1, TEXT_AT_ONCE):
                bits, chars = known.of_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(bits), pa.list_(pa.float64())), pa.array(chars)], ["lang", "bits", "chars"])

    rows_out = sample.where(kept_out & F.col("lang").isin(model.languages)).select("lang", "text")
    found = rows_out.mapInArrow(run, "lang string, bits array<double>, chars long").where("chars > 0").collect()  # held_out rows a language
    if found:
        at = {lang: k for k, lang in enumerate(model.languages)}
        calibrate(model, np.array([at[r["lang"]] for r in found]), np.array([r["bits"] for r in found]), np.array([r["chars"] for r in found], np.float64))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col, *keep, lang_pred, score, entropy, rejected) for every row, whole texts.

    Null texts and texts without a letter, and every text if nothing was learned, get `und`, score 0 and are rejected. score: the winner's share of
    the languages' likelihoods of the whole text, at the model's temperature. Equal entropies: the first language by name. Repeated rows are
    predicted each. A column of `keep` must not have the name of a new one: ValueError.
    """
    if clash := {"lang_pred", "score", "entropy", "rejected"} & {id_col, *(keep or [])}:
        raise ValueError(f"columns have the names of new ones: {sorted(clash)}")
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *(keep or []))
    names = rows.columns[1:]
    languages = np.array([*model.languages, UNKNOWN], object)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = word_bits(model)
        for batch in batches:
            for part in slices(batch, 0, TEXT_AT_ONCE):
                if model.languages:
                    bits, chars = known.of_texts(part.column(0))
                    mean = bits / np.maximum(1, chars)[:, None]
                    best = mean.argmin(axis=1)
                    least = mean[np.arange(len(best)), best]
                    share = 1 / np.exp2(model.temperature * (bits.min(axis=1)[:, None] - bits)).sum(axis=1)
                    none = chars == 0
                    rejected = none | (least > model.limit(best, chars))
                    best, share, least = np.where(none, len(languages) - 1, best), np.where(none, 0.0, share), np.where(none, 0.0, least)
                else:
                    n = part.num_rows
                    best, share, least, rejected = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(languages[best], pa.string()), pa.array(share), pa.array(least), pa.array(rejected)], [*names, "lang_pred", "score", "entropy", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, entropy double, rejected boolean")


def fold(id_col: str = "doc_id") -> F.Column:
    """The row's fold of 5 by the CRC-32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)), F.lit(0))
