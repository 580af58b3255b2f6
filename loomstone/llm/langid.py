"""Language identification by nearest centroids.

Texts become TF-IDF vectors of hashed character n-grams, of unit length. Each language has several centroids,
clustered by cosine; a text takes the language of the nearest. A text further from its centroid than nearly all
of the centroid's own is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

#: Hashed features, centroids of a language, and documents of a language that the clustering is fitted on (expected).
WIDTH, CENTROIDS, FIT_DOCS = 4096, 3, 600
#: Sharpness of the score, and the part of a centroid's own documents that would be rejected.
SHARPNESS, REJECT = 25.0, 0.002
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that part words: controls, blanks, digits, ASCII punctuation.
FOLD = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of the UTF-8 bytes of the folded text, WIDTH of them."""
    b = FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(WIDTH, np.float32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    shift = np.uint32(32 - 12)
    h2 = (two * np.uint32(2654435761) + np.uint32(0x5BD1)) >> shift
    h3 = (three * np.uint32(2246822519)) >> shift
    return (np.bincount(h3, minlength=WIDTH) + np.bincount(h2, minlength=WIDTH)).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.stack([features(t) for t in texts])
        np.log1p(x, out=x)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cosine, rejected) for each text."""
        cos = self.vectors(texts) @ self.centroids.T
        names = sorted(set(self.langs))
        by = np.stack([cos[:, [k for k, x in enumerate(self.langs) if x == n]].max(1) for n in names], 1)
        best, near = by.argmax(1), cos.argmax(1)
        e = np.exp(SHARPNESS * (by - by.max(1, keepdims=True)))
        return [names[k] for k in best], 1 / e.sum(1), cos.max(1), cos.max(1) < self.floors[near]


def cluster(x: np.ndarray, k: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; starts far apart, from the row nearest to the mean. Returns centroids and each row's one."""
    mean = x.mean(0)
    centers = [x[(x @ mean).argmax()]]
    while len(centers) < min(k, len(x)):
        centers.append(x[(x @ np.stack(centers).T).max(1).argmin()])
    c = np.stack(centers)
    for _ in range(turns):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, (x @ c.T).argmax(1)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, centroids: int = CENTROIDS) -> Model | None:
    """A model from text and lang of rows whose crc32(doc_id as text) mod 3 is not 1; None if there are none.

    Document frequencies come from all these rows, the clusters from about fit_docs of each language, taken by a hash.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 1)).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                df += features(t) > 0
                n += 1
        yield pd.DataFrame({"feature": np.arange(WIDTH + 1), "n": np.append(df, n)})

    langs = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not langs:
        return None
    table = train.select("text").mapInPandas(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(WIDTH + 1)
    counts[table["feature"]] = table["n"]
    idf = (np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.05).astype(np.float32)

    from itertools import chain

    part = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, fit_docs / n))) for k, n in langs.items()))
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part[F.col("lang")] * F.lit(float(1 << 30)))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "at": [np.flatnonzero(r).astype(np.int32) for r in rows], "n": [r[r > 0] for r in rows]})

    sample = chosen.select("lang", "text").mapInPandas(sparse, "lang string, at array<int>, n array<float>").toPandas()
    model = Model(idf, np.zeros((0, WIDTH), np.float32), [], np.zeros(0))
    all_centroids, names, floors = [], [], []
    for lang, own in sample.groupby("lang"):
        x = np.zeros((len(own), WIDTH), np.float32)
        for k, (at, n) in enumerate(zip(own["at"], own["n"])):
            x[k, at] = n
        x = np.log1p(x) * idf
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            continue
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c, near = cluster(x, centroids)
        cos = (x * c[near]).sum(1)
        all_centroids.append(c)
        names += [lang] * len(c)
        floors += [float(np.quantile(cos[near == j], REJECT)) if (near == j).any() else 0.0 for j in range(len(c))]
    if not names:
        return None
    model.centroids, model.langs, model.floors = np.concatenate(all_centroids), names, np.array(floors)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cosine, rejected for every row of docs, from its text alone.

    `und` with score 0 if the text is null or has no letter, or if there is no model. A null doc_id is not held out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.iloc[at : at + 256]
                ok = np.array([isinstance(t, str) and bool(LETTER.search(t)) for t in batch["text"]], bool)
                if model is None:
                    ok[:] = False
                out = pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": "und", "score": 0.0, "cosine": 0.0, "rejected": True})
                if ok.any():
                    lang, score, cos, bad = model.predict(batch["text"][ok].tolist())
                    out.loc[ok, "lang_pred"] = lang
                    out.loc[ok, "score"] = score.astype(float)
                    out.loc[ok, "cosine"] = cos.astype(float)
                    out.loc[ok, "rejected"] = bad
                yield out

    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, cosine double, rejected boolean")
