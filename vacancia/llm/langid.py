"""Language identification by error-correcting output codes.

Each language has a codeword, and one binary classifier per bit predicts from
hashed character n-grams whether a text's language has that bit. Decoding sums,
per codeword, the hinge losses of the predicted margins, each bit weighted by
how reliable its classifier was in training; the nearest codeword wins. A text
whose second-best codeword is about as near is flagged as ambiguous.

The classifiers are ridge regressions on n-gram profiles of a bounded sample of
labelled documents (``TRAIN_ROWS``, spread evenly over the languages and over
the table). Profiles are counted in tasks over whole texts; the driver gets one
profile of ``DIMENSIONS`` halves a sampled document.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.texts import map_texts, whole

#: Labelled documents that are fitted at most, about; every language gets its even part, 20 at least.
TRAIN_ROWS = 3000
#: Languages at most; a column with more is no language column.
MOST_LANGUAGES = 500
DIMENSIONS = 4096
RIDGE = 0.05
#: Languages up to this number get the exhaustive code, more a random one.
EXHAUSTIVE = 5
#: A lead over the second-best codeword below this share of the weights is ambiguous.
AMBIGUOUS = 0.1
UNDETERMINED = "und"
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text is a multiple of five; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def profile(text: str) -> np.ndarray:
    """Normalised square roots of the counts of hashed byte 2-, 3- and 4-grams of the lower-cased letters."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8").translate(_LETTERS) + b" ", np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data), _STEP):
        x = data[at: at + _STEP + 3].astype(np.uint32)
        fresh = min(_STEP, len(data) - at)
        gram = x[:-1] << np.uint32(8) | x[1:]
        for n in (2, 3, 4):
            if n > 2:
                if len(x) < n:
                    break
                gram = gram[: len(x) - n + 1] << np.uint32(8) | x[n - 1:]
            # Grams that start in the next stretch are counted there; runs of blanks say nothing.
            own = gram[:fresh]
            own = own[(own & 0xFFFF) != 0x2020]
            slot = ((own + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(slot, minlength=DIMENSIONS)
    root = np.sqrt(counts.astype(np.float32))
    size = np.linalg.norm(root)
    return root / size if size else root


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 per language; columns are neither constant nor equal up to sign."""
    if languages <= 1:
        return np.ones((languages, 1), np.float32)
    if languages <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(columns, np.float32).T
    bits = int(np.ceil(10 * np.log2(languages)))
    rng = np.random.default_rng(seed)
    best, reach = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (languages, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        mixed = (np.abs(code.sum(axis=0)) < languages).all()
        if mixed and apart.min() > reach:
            best, reach = code, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score between 0 and 1, and whether the call is ambiguous."""
        margin = profiles @ self.weights + self.bias
        loss = np.maximum(0, 1 - margin[:, None, :] * self.code[None]) @ self.trust / self.trust.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        score = 1 / near.sum(axis=1)
        if len(self.languages) > 1:
            rows = np.arange(len(loss))
            lead = loss[rows, order[:, 1]] - loss[rows, order[:, 0]]
        else:
            lead = np.ones(len(loss))
        return order[:, 0], score, lead < AMBIGUOUS


def fit_model(profiles: np.ndarray, labels: list[str]) -> Model:
    """Ridge regressions of the code bits on the profiles, solved in the smaller dimension."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    row = {lang: i for i, lang in enumerate(languages)}
    which = np.array([row[x] for x in labels])
    y = code[which]
    # Every language weighs the same, whatever its share of the sample.
    share = np.sqrt(len(labels) / len(languages) / np.bincount(which, minlength=len(languages)))[which][:, None]
    x = profiles.astype(np.float32)
    middle = (x * share ** 2).sum(axis=0) / (share ** 2).sum()
    centre = (y * share ** 2).sum(axis=0) / (share ** 2).sum()
    a, b = (x - middle) * share, (y - centre) * share
    if len(a) > a.shape[1]:
        weights = np.linalg.solve(a.T @ a + RIDGE * np.eye(a.shape[1], dtype=np.float32), a.T @ b)
    else:
        weights = a.T @ np.linalg.solve(a @ a.T + RIDGE * np.eye(len(a), dtype=np.float32), b)
    bias = centre - middle @ weights
    right = ((x @ weights + bias) * y > 0).mean(axis=0)
    return Model(languages, code, weights.astype(np.float32), bias.astype(np.float32),
                 np.maximum(right - 0.5, 0.01).astype(np.float32))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          rows: int = TRAIN_ROWS, seed: int = 3) -> Model | None:
    """The model of the labelled documents that are not held out; None if there are none."""
    d = docs.select(docs[doc_id].alias("i"), docs[lang].cast("string").alias("l"), docs[text].alias("t"))
    d = d.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    sizes = {r[0]: r[1] for r in d.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    each = max(20, rows // len(sizes))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "i", "t"), F.lit(1 << 30)) / float(1 << 30)
    chance = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        chance = F.when(F.col("l") == name, F.lit(each / n)).otherwise(chance)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"l": batch["l"], "p": [profile(t).astype(np.float16).tobytes() for t in batch["t"]]})
    found = d.filter(drawn < chance).select("l", "t").mapInPandas(count, "l string, p binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["l"], bytes(r["p"])))
    return fit_model(np.stack([np.frombuffer(r["p"], np.float16) for r in found]).astype(np.float32),
                     [r["l"] for r in found])


def predict_languages(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every document.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if nothing was learned. Null ids and repeated rows are carried along.
    """
    t = whole(docs[text])
    lettered = t.rlike(r"\p{L}")
    rows = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"),
                       F.when(lettered, t).alias("t"))

    def compute():
        def each(texts: list[str | None]) -> list[tuple]:
            out = [(UNDETERMINED, 0.0, True)] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None and model is not None]
            for at in range(0, len(known), 512):
                part = known[at: at + 512]
                best, score, unsure = model.decode(np.stack([profile(texts[i]) for i in part]))
                for i, b, s, u in zip(part, best, score.tolist(), unsure.tolist(), strict=True):
                    out[i] = (model.languages[b], s, u)
            return out
        return each
    return map_texts(rows, "t", compute, {"lang_pred": "string", "score": "double", "ambiguous": "boolean"})


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Train on the labelled part of ``docs`` and predict all of it; the label, source and id are no inputs."""
    return predict_languages(docs, train(docs, text, lang, doc_id), text, doc_id)
