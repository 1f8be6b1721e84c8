"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient
descent in numpy, with a temperature and a rejection bound calibrated on rows kept out of the training.

Nothing but the text enters a prediction. Since both layers are linear, the trained model is one table of logits per
subword bucket (buckets x languages), which has a fixed size and is what the executors get.

Defined results: a text that is null, empty or without a letter (Unicode category L; ½, ² and Ⅳ are none) gets `und`, score 0 and is rejected; rows with a null id
are left out and repeated ids count once (see common.keyed); without a labelled row the model knows no language and
every text is `und`. Texts of any length are read whole."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.llm.common import batch_of, forget_caches, keyed, pairs

LETTER = regex.compile(r"\p{L}")
UND = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Of each code point below 65536, whether it is a letter."""
    return np.array([bool(LETTER.match(chr(c))) for c in range(1 << 16)])


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, places in `words`) of all 1- to 4-grams of the words' letters. Whatever is no letter, and each end of a
    word, is a gap; a gram may begin or end with a gap, which marks the ends of a run of letters, but not hold one within."""
    flat = np.frombuffer(("\n" + "\n\n".join(words).lower() + "\n").encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = flat == 10
    owner = np.cumsum(ends) // 2
    owner[ends] = np.repeat(np.arange(len(words)), 2)
    high = np.flatnonzero(flat >= 1 << 16)
    real = letters()[np.minimum(flat, (1 << 16) - 1).astype(np.int64)]
    real[high] = [bool(LETTER.match(chr(int(c)))) for c in flat[high]]
    flat = np.where(real, flat, np.uint64(0))
    grams, owners = [], []
    for n in range(1, 5):
        k = len(flat) - n + 1
        if k < 1:
            break
        h, inner, some = np.full(k, np.uint64(n)), np.ones(k, bool), np.zeros(k, bool)
        for j in range(n):
            h = (h ^ flat[j : j + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            some |= real[j : j + k]
            if 0 < j < n - 1:
                inner &= real[j : j + k]
        good = np.flatnonzero(inner & some & (owner[:k] == owner[n - 1 : n - 1 + k]))
        grams.append((h[good] % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[good])
    return np.concatenate(grams), np.concatenate(owners)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # buckets x languages, divided by the temperature
    bound: float  # scores below it are rejected

    @property
    def buckets(self) -> int:
        return len(self.logits)


class Scorer:
    """Logits of texts from those of their words, each distinct word looked at once; forgets after `keep` words."""

    def __init__(self, model: LanguageModel, keep: int = 200_000):
        self.model, self.keep = model, keep
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages) + 1))

    def learn(self, words: set) -> None:
        if len(self.row) > self.keep:
            self.reset()
        new = [w for w in words if w not in self.row]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            grams, owner = subwords(part, self.model.buckets)
            first = len(self.row)
            while first + len(part) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            for lang in range(len(self.model.languages)):
                self.sums[first : first + len(part), lang] = np.bincount(owner, self.model.logits[:, lang][grams], len(part))
            self.sums[first : first + len(part), -1] = np.bincount(owner, minlength=len(part))
            self.row.update(zip(part, range(first, first + len(part)), strict=True))

    def score(self, texts: list) -> list[tuple[str, float]]:
        """Texts together, a few megabytes at a time: new words are then looked at in large groups."""
        out, k = [], 0
        while k < len(texts):
            size, part = 0, []
            while k < len(texts) and size < 4_000_000:
                part.append((texts[k] or "").split())
                size += len(texts[k] or "")
                k += 1
            if self.model.languages:
                self.learn(set().union(*part))
            out += [self.said(words, texts[k - len(part) + i]) for i, words in enumerate(part)]
        return out

    def said(self, words: list[str], text: str | None) -> tuple[str, float]:
        if not self.model.languages or not words or not LETTER.search(text):
            return UND, 0.0
        total = self.sums[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(0)
        z = total[:-1] / total[-1]
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.model.languages[k], float(p[k])


def train(rows: list[tuple[str, str]], buckets: int = 1 << 15, dim: int = 16, epochs: int = 8, rate: float = 0.5, reject: float = 0.001, seed: int = 7) -> LanguageModel:
    """rows: (text, language). Every fifth row calibrates: the temperature with the least log loss over segments, and the
    score under which at most a share `reject` of whole, rightly predicted texts falls (0.5 at most)."""
    rows = [(t, lang) for t, lang in rows if t and lang is not None and LETTER.search(t)]
    languages = sorted({lang for _, lang in rows})
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((1, len(languages))), 0.0)
    rng = np.random.default_rng(seed)
    words = sorted({w for text, _ in rows for w in text.split()})
    grams, owner = subwords(words, buckets)
    order = np.argsort(owner, kind="stable")
    parts = np.split(grams[order], np.searchsorted(owner[order], np.arange(1, len(words))))
    ids_of = dict(zip(words, parts, strict=True))
    data = [([ids_of[w] for w in text.split() if len(ids_of[w])], languages.index(lang)) for text, lang in rows]
    held, fit = data[::5], [d for k, d in enumerate(data) if k % 5] or data
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out = np.zeros((dim, len(languages)))
    share = np.bincount([y for _, y in fit], minlength=len(languages)).astype(float)
    weight = np.minimum(share.mean() / np.maximum(share, 1), 4)
    sizes = np.array([1, 2, 4, 8, 16, 48])

    def segment(words: list, n: int) -> np.ndarray:
        if n >= len(words):
            return np.concatenate(words)
        k = int(rng.integers(0, len(words) - n + 1))
        return np.concatenate(words[k : k + n])

    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            words, y = fit[k]
            ids = segment(words, int(rng.choice(sizes)))
            h = emb[ids].mean(0)
            z = h @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * weight[y] * (1 - done / steps)
            back = out @ p
            out -= lr * np.outer(h, p)
            np.subtract.at(emb, ids, lr * back / len(ids) * 8)
            done += 1
    logits = emb @ out
    zs = [(logits[segment(w, n)].mean(0), y) for w, y in held for n in (2, 8, 48)]
    z, y = np.array([a for a, _ in zs]), np.array([b for _, b in zs])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    best = min(np.geomspace(0.05, 4, 30), key=loss)
    model = LanguageModel(languages, logits / best, 0.0)
    whole = []
    for words, y in held:
        s = model.logits[np.concatenate(words)].mean(0)
        p = np.exp(s - s.max())
        if int(s.argmax()) == y:
            whole.append(float(p.max() / p.sum()))
    bound = min(0.5, float(np.quantile(whole, reject))) if whole else 0.0
    return LanguageModel(languages, model.logits.astype(np.float32), bound)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5; rows of fold 0 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, languages: int = 256, **options) -> LanguageModel:
    """Train on at most `per_language` labelled rows of each of the `languages` most frequent labels outside fold 0, chosen by a
    hash of the id (a bounded sample; the two parameters are its bound). Only ids and labels are ranked; texts are read for the
    chosen rows alone."""
    names = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = names.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    frequent = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    labelled = labelled.join(F.broadcast(frequent), "lang", "left_semi")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = labelled.select("doc_id", "lang").withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id")
    rows = labelled.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("doc_id", "text", "lang").collect()
    rows = sorted({(r["doc_id"], r["lang"], r["text"]) for r in rows})
    return train([(text, lang) for _, lang, text in rows], **options)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected; one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        forget_caches()
        scorer = Scorer(shared.value)
        for b in batches:
            ids, said = b.column(0), scorer.score([t for _, t in pairs(b)])
            yield batch_of(schema, [ids.cast(pa.int64()), [x for x, _ in said], [s for _, s in said], [x == UND or s < shared.value.bound for x, s in said]])

    return keyed(docs, id_col, text_col).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on the documents' own labelled rows and predict all of them: doc_id, held_out, lang_pred, score, rejected."""
    said = identify(docs, fit_languages(docs, id_col, text_col, lang_col, **options), id_col, text_col)
    return said.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")
