"""Language identification with interpolated Kneser-Ney character models.

Texts are read as letters: letters in lower case, every other stretch one blank,
a blank at either end.  For each language n-gram counts of up to ``ORDER``
characters are taken from a bounded sample of its documents and smoothed after
Kneser and Ney: the highest order keeps its counts, lower ones count distinct
left neighbours, and each order is interpolated with the next with its own
discount.  All languages share one sorted array of n-gram hashes for each order,
with a column of log probabilities and back-off weights for each language; a
position is looked up from the highest order down.

The language of least cross-entropy a character wins.  ``score`` is its posterior
after a temperature fitted on sample documents that the counts have not seen.  The
same documents calibrate the rejection: a text is rejected if its cross-entropy is
over its language's usual one by more than any of those documents shows, with a
margin, and by more than ``WIDTH`` deviations, which are wider for short texts.

Defined cases: null texts and texts without a letter get ``und``, score 0, and are
rejected; rows without a language are not learnt from; without any labelled row
every text gets ``und``; over ``MOST_LANGUAGES`` distinct languages are an error; equal entropies go to the first language by code point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import staging
from . import bytesops as B

ORDER = 4
#: Documents of each language that are sampled to learn from; of these, every ``ASIDE``-th calibrates.
MOST_DOCUMENTS, ASIDE = 1500, 5
#: Languages that a model can hold, as each is a column of its tables; more distinct values are an error.
MOST_LANGUAGES = 2000
#: What is accepted over the usual cross-entropy: ``WIDTH`` deviations, and at least ``MARGIN`` times the
#: most that a calibration document of ``LONG`` characters shows.
WIDTH, MARGIN, LONG = 10.0, 1.5, 200
BLANK = 32
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    if not _tables:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables.append(out)
    return _tables[0]


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts in a row, where each text begins, and its number of letters."""
    data, offsets = B.closed(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offsets]
    low = _letter_table()[points]
    is_letter = low > 0
    counts = B.per_document(is_letter, at)
    # blanks: only the first of a stretch, one at the start and (the closing line feed) one at the end of a text
    stay = is_letter.copy()
    stay[1:] |= is_letter[:-1]
    stay[at[:-1]] |= is_letter[at[:-1]]
    chars = np.where(is_letter, low, BLANK).astype(np.uint32)[stay]
    ends = np.concatenate([[0], np.cumsum(stay)])[at]
    return chars, ends, counts


PLACES = [np.uint64(pow(B.BASE, 3 * k + 5, 1 << 64)) for k in range(8)]


def lead(chars: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The characters with ``order`` blanks before each text, as the n-grams see them, and the places of the real ones."""
    length = np.diff(starts)
    places = np.arange(len(chars)) + order * np.repeat(np.arange(1, len(length) + 1), length)
    out = np.full(len(chars) + order * len(length), BLANK + 1, np.uint64)
    out[places] = chars.astype(np.uint64) + np.uint64(1)
    return out, places


def grams(padded: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each of the places."""
    out = padded[places] * PLACES[0]
    for k in range(1, n):
        out += padded[places - k] * PLACES[k]
    return B.mixed(out)


def all_grams(padded: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """:func:`grams` where the places are most of the characters."""
    out = padded * PLACES[0]
    for k in range(1, n):
        out[k:] += padded[:-k] * PLACES[k]
    return B.mixed(out[places])


def hash_of(columns: list[np.ndarray]) -> np.ndarray:
    """The same hash from columns of characters, the latest last."""
    out = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(reversed(columns)):
        out += (c.astype(np.uint64) + np.uint64(1)) * PLACES[k]
    return B.mixed(out)


def count_grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the highest order as rows of characters, and their counts."""
    chars, starts, _ = letters(texts)
    if not len(chars):
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
    since = np.arange(len(chars)) - np.repeat(starts[:-1], np.diff(starts))
    cols = []
    for k in range(order - 1, -1, -1):
        back = np.full(len(chars), BLANK, np.uint32)
        if k < len(chars):
            back[k:] = chars[: len(chars) - k]
        back[since < k] = BLANK
        cols.append(back)
    _, first, n = np.unique(hash_of(cols), return_index=True, return_counts=True)
    return np.column_stack(cols)[first], n


@dataclass
class Table:
    """One order: sorted hashes, log probability and (as a context) log back-off by language."""

    keys: np.ndarray
    logp: np.ndarray
    back: np.ndarray
    first: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1.  Leading bits give the place to look from, as hashes are spread evenly."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        if self.first is None:
            bits = max(1, len(self.keys).bit_length() + 1)
            self.shift = np.uint64(64 - bits)
            self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
            self.padded = np.append(self.keys, np.uint64(2**64 - 1))
        at = self.first[hashes >> self.shift]
        key = self.padded[at]
        out = np.where(key == hashes, at, -1)
        open_ = np.flatnonzero(key < hashes)
        at = at[open_] + 1
        while len(open_):
            key = self.padded[at]
            hit = key == hashes[open_]
            out[open_[hit]] = at[hit]
            on = (key < hashes[open_]) & (at < len(self.keys))
            open_, at = open_[on], at[on] + 1
        return out


def discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


@dataclass
class Model:
    languages: list[str]
    order: int
    tables: list[Table]
    floor: float
    usual: np.ndarray
    spread: np.ndarray
    spread_char: np.ndarray
    heat: float = 1.0
    slack: float = 0.0

    @classmethod
    def learn(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
        """From each language's n-grams of the highest order and their counts."""
        languages = sorted(counts)
        if not languages:
            return cls([], order, [], 0.0, np.zeros(0), np.ones(0), np.ones(0))
        alphabet = len(set().union(*[set(np.unique(g).tolist()) for g, _ in counts.values()])) + 1
        per: list[dict[int, tuple]] = []
        for k in languages:
            g, n = counts[k]
            levels = {}
            for m in range(order, 0, -1):
                key = hash_of([g[:, i] for i in range(order - m, order)])
                _, first, inv = np.unique(key, return_index=True, return_inverse=True)
                if m == order:
                    levels[m] = (g, n.astype(float))
                    continue
                # continuation counts: distinct n-grams one longer that end in this one
                longer = hash_of([g[:, i] for i in range(order - m - 1, order)])
                _, one = np.unique(longer, return_index=True)
                levels[m] = (g[first][:, order - m :], np.bincount(inv[one], minlength=len(first)).astype(float))
            per.append(levels)
        tables = []
        lower: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0))] * len(languages)
        for m in range(1, order + 1):
            found = []
            for j, levels in enumerate(per):
                g, c = levels[m]
                key = hash_of([g[:, i] for i in range(m)])
                ctx = hash_of([g[:, i] for i in range(m - 1)]) if m > 1 else np.zeros(len(g), np.uint64)
                ctxs, inv = np.unique(ctx, return_inverse=True)
                mass, kinds = np.bincount(inv, c), np.bincount(inv)
                d = discount(c)
                spare = d * kinds / mass
                if m == 1:
                    below = np.full(len(g), 1 / alphabet)
                else:
                    short = hash_of([g[:, i] for i in range(1, m)])
                    order_ = np.argsort(lower[j][0])
                    below = lower[j][1][order_][np.searchsorted(lower[j][0][order_], short)]
                p = (c - d) / mass[inv] + spare[inv] * below
                lower[j] = (key, p)
                found.append((key, p, ctxs, spare))
            keys = np.unique(np.concatenate([f[0] for f in found]))
            logp = np.full((len(keys), len(languages)), np.nan)
            ctx_keys = np.unique(np.concatenate([f[2] for f in found]))
            back = np.zeros((len(ctx_keys), len(languages)))
            for j, (key, p, ctxs, spare) in enumerate(found):
                logp[np.searchsorted(keys, key), j] = np.log(p)
                back[np.searchsorted(ctx_keys, ctxs), j] = np.log(spare)
            tables.append((keys, logp, ctx_keys, back))
        # where a language lacks an n-gram of the shared array its probability comes from the next order
        floor = math.log(1 / alphabet)
        out: list[Table] = []
        spell = np.concatenate([counts[k][0] for k in languages])
        for m in range(1, order + 1):
            keys, logp, ctx_keys, back = tables[m - 1]
            all_ = hash_of([spell[:, i] for i in range(order - m, order)])
            _, first = np.unique(all_, return_index=True)
            g = spell[first][:, order - m :]
            ctx = hash_of([g[:, i] for i in range(m - 1)]) if m > 1 else np.zeros(len(g), np.uint64)
            weight = back[np.searchsorted(ctx_keys, ctx)]
            if m == 1:
                below = np.full((len(g), len(languages)), floor)
            else:
                below = out[-1].logp[np.searchsorted(out[-1].keys, hash_of([g[:, i] for i in range(1, m)]))]
            logp = np.where(np.isnan(logp), weight + below, logp)
            out.append(Table(keys, logp.astype(np.float32), np.zeros((0, len(languages)), np.float32)))
            if m > 1:  # back-off weights stand by the context, an n-gram of the order before
                weights = np.zeros((len(out[-2].keys), len(languages)), np.float32)
                at = out[-2].find(ctx_keys)
                weights[at[at >= 0]] = back[at >= 0]
                out[-2].back = weights
            else:
                start = back[0].astype(np.float32)
        model = cls(languages, order, out, floor, np.zeros(len(languages)), np.ones(len(languages)), np.ones(len(languages)))
        model.start = start
        return model

    def positions(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probability of each character in each language."""
        padded, places = lead(chars, starts, self.order)
        at = self.tables[-1].find(all_grams(padded, places, self.order))
        out = self.tables[-1].logp[at]
        left = np.flatnonzero(at < 0)
        out[left] = 0
        for m in range(self.order, 0, -1):
            table, where = self.tables[m - 1], places[left]
            if m < self.order:
                at = table.find(grams(padded, where, m))
                hit = at >= 0
                out[left[hit]] += table.logp[at[hit]]
                left, where = left[~hit], where[~hit]
            if m > 1 and len(left):  # the context is the n-gram one shorter that ends a character before
                at = self.tables[m - 2].find(grams(padded, where - 1, m - 1))
                seen = at >= 0
                out[left[seen]] += self.tables[m - 2].back[at[seen]]
        out[left] += self.start + np.float32(self.floor)
        return out

    def entropies(self, texts: pa.Array, squares: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character by language, number of characters, of letters, and the sums of squares."""
        chars, starts, n_letters = letters(texts)
        length = np.diff(starts)
        xent = np.full((len(length), len(self.languages)), np.inf)
        square = np.zeros_like(xent)
        full = np.flatnonzero(length)
        if len(full) and len(self.languages):
            logp = self.positions(chars, starts)
            xent[full] = -np.add.reduceat(logp, starts[:-1][full], dtype=np.float64) / length[full, None]
            if squares:
                square[full] = np.add.reduceat(logp * logp, starts[:-1][full], dtype=np.float64) / length[full, None]
        return xent, length, n_letters, square

    def calibrate(self, texts: pa.Array, langs: np.ndarray) -> None:
        """Usual entropies, their spreads and the temperature, from documents that the counts have not seen."""
        if not len(texts) or not self.languages:
            return
        parts = [self.entropies(texts.slice(a, b - a), True) for a, b in B.slices(texts)]
        xent, length, n_letters, square = (np.concatenate([p[i] for p in parts]) for i in range(4))
        index = {k: i for i, k in enumerate(self.languages)}
        true = np.array([index.get(k, -1) for k in langs])
        ok = (true >= 0) & (n_letters > 0)
        xent, length, true, square = xent[ok], length[ok], true[ok], square[ok]
        for j in range(len(self.languages)):
            own = true == j
            if own.sum() < 2:
                self.usual[j], self.spread[j], self.spread_char[j] = math.inf, math.inf, 0
                continue
            x, w = xent[own, j], length[own].astype(float)
            self.usual[j] = (x * w).sum() / w.sum()
            self.spread_char[j] = math.sqrt(max(0.0, (square[own, j] * w).sum() / w.sum() - self.usual[j] ** 2))
            self.spread[j] = max(0.05, math.sqrt(((x - self.usual[j]) ** 2 * w).sum() / w.sum()))
        if len(true):
            off = (xent[np.arange(len(true)), true] - self.usual[true])[length >= LONG]
            self.slack = MARGIN * float(off.max(initial=0.0))
        best = (math.inf, 1.0)
        for heat in np.geomspace(0.5, 200, 40):
            z = -(xent - xent.min(axis=1, keepdims=True)) * heat
            loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), true]).mean()) if len(z) else 0.0
            best = min(best, (loss, float(heat)))
        self.heat = best[1]

    def deviation(self, lang: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of a text's cross-entropy in its own language; short texts vary more."""
        return np.sqrt(self.spread[lang] ** 2 + self.spread_char[lang] ** 2 / np.maximum(length, 1))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), score, cross-entropy, rejected."""
        xent, length, n_letters, _ = self.entropies(texts)
        if not self.languages:
            n = len(length)
            return np.full(n, -1), np.zeros(n), np.zeros(n), np.ones(n, bool)
        lang = xent.argmin(axis=1)
        least = xent[np.arange(len(lang)), lang]
        none = n_letters == 0
        with np.errstate(invalid="ignore"):
            z = np.exp(-(xent - least[:, None]) * self.heat)
        score = np.where(none, 0.0, 1 / np.where(none, 1.0, np.nan_to_num(z.sum(axis=1), nan=1.0)))
        rejected = none | (least > self.usual[lang] + np.maximum(self.slack, WIDTH * self.deviation(lang, length)))
        return np.where(none, -1, lang), score, np.where(none, 0.0, least), rejected


def sample(docs: DataFrame, lang: str, key: str, text: str, most: int, seed: int) -> DataFrame:
    """At most about ``most`` documents of each language, those of the least hashes of their key; the least is never set aside."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30))
    keyed = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), draw.alias("_draw"))
    sizes = staging.stage(keyed.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_draw").alias("_least")), "languages")
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    picked = keyed.join(F.broadcast(sizes), "_lang").where(F.col("_draw") < F.lit(float(most << 30)) / F.col("_n"))
    return picked.select("_lang", "_text", ((F.pmod("_draw", F.lit(ASIDE)) == 0) & (F.col("_draw") > F.col("_least"))).alias("_aside"))


def fit(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", order: int = ORDER, most: int = MOST_DOCUMENTS, seed: int = 5) -> Model:
    """Learn from the rows of ``docs``; the sample's n-grams are counted by Spark."""
    some = sample(docs, lang, doc_id, text, most, seed)
    names = [f"c{k}" for k in range(order)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("_lang").unique().to_pylist():
                own = batch.filter(pa.compute.equal(batch.column("_lang"), k)).column("_text")
                for a, b in B.slices(own):
                    g, n = count_grams(own.slice(a, b - a), order)
                    yield pa.record_batch([pa.array([k] * len(n), pa.string()), *[pa.array(g[:, i].astype(np.int32)) for i in range(order)], pa.array(n)], names=["lang", *names, "n"])

    schema = "lang string, " + ", ".join(f"{c} int" for c in names) + ", n long"
    table = some.where(~F.col("_aside")).mapInArrow(counted, schema).groupBy("lang", *names).agg(F.sum("n").alias("n")).toPandas()
    counts = {k: (t[names].to_numpy(np.uint32), t["n"].to_numpy(np.int64)) for k, t in table.groupby("lang")}
    model = Model.learn(counts, order)
    held = some.where("_aside").select("_lang", "_text").toPandas()
    model.calibrate(pa.array(held["_text"], pa.string()), held["_lang"].to_numpy())
    return model


DDL = "struct<lang_pred:string,score:double,entropy:double,rejected:boolean>"


def identify(model: Model, text: Column) -> Column:
    """Language, score, cross-entropy (bits a character) and rejection of each whole text."""
    held = _broadcast(model)

    @arrow_udf(DDL)
    def of(texts: pa.Array) -> pa.Array:
        m = held.value
        names = np.array([*m.languages, UNKNOWN], object)
        parts = [m.predict(texts.slice(a, b - a)) for a, b in B.slices(texts)]
        lang, score, xent, rejected = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((int, float, float, bool)))
        return pa.StructArray.from_arrays([pa.array(names[lang], pa.string()), pa.array(score), pa.array(xent / math.log(2)), pa.array(rejected)], names=["lang_pred", "score", "entropy", "rejected"])

    return of(text)


def _broadcast(model: Model):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)
