"""Language of texts by nearest centroid over TF-IDF letter n-grams.

A text becomes the counts of its letter pairs and triples (case folded; everything but
letters is one blank) hashed into ``BINS`` bins, weighted by ``log(1 + tf) * idf`` and
normalised. Each language has several centroids, found by k-means on the unit sphere from
labelled texts. The language of a text is that of the centroid of the largest cosine; the
score is that cosine. A text is rejected if it has no letter, or if its cosine is below what its
number of n-grams lets one expect: ``REJECT`` times the least usual cosine (first
percentile) of training texts of about its length.

Fitting reads at most ``PER_LANG`` texts of a language and ``SAMPLE`` in all, chosen by a
hash of the id, so the model is the same for any partitioning. Everything else covers all
rows and whole texts, and prediction sees the text alone.

Nulls and repeats: null or letterless texts are ``und`` with score 0 and rejected; null
languages are not learned from; with no labelled text every prediction is ``und``; repeated
rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import map_batches, without

BINS = 1 << 13
PER_LANG = 250
SAMPLE = 2000
CENTROIDS = 4
REJECT = 0.5
#: Code points counted at once.
STRETCH = 1 << 18
#: Texts scored at once.
ROWS = 64
#: Texts are compared with those of about their length: powers of two of their n-grams.
LENGTHS = 24
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter pairs and triples, or None without letters."""
    parts = [np.zeros(1, np.uint32)]
    for s in range(0, len(text or ""), STRETCH):
        points = np.frombuffer(text[s : s + STRETCH].lower().encode("utf-32-le", "replace"), np.uint32)
        points = np.where(letters()[points], points, 0)
        before = np.concatenate([parts[-1][-1:], points[:-1]])
        if len(points := points[(points != 0) | (before != 0)]):
            parts.append(points)
    if len(parts) == 1:
        return None
    x, counts = np.concatenate([*parts, np.zeros(1 + (parts[-1][-1] != 0), np.uint32)]), np.zeros(BINS, np.int64)
    for s in range(0, len(x) - 2, STRETCH):
        a, b, c = (x[s + i : min(s + STRETCH, len(x) - 2) + i].astype(np.uint64) for i in range(3))
        two = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two * np.uint64(31) + c * np.uint64(0x165667B19E3779F9))[b != 0]
        for h in (two, three):
            bins = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(51)
            counts += np.bincount(bins.astype(np.int64), minlength=BINS)
    return counts


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine by length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = counts.astype(np.float32)
        np.log1p(v, out=v)
        v *= self.idf
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
        return v

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, whether rejected) of each row of counts."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return self.owner[best], score, score < self.floor[length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)).astype(np.int64), LENGTHS - 1)


def clusters(v: np.ndarray, k: int, seed: int = 7, rounds: int = 20) -> np.ndarray:
    """Unit centroids of the rows of ``v`` by k-means with cosines."""
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(1)
        sums = np.stack([v[near == j].sum(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Centroids from a bounded sample of ``labelled``."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col)
    sizes = dict(known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(SAMPLE).collect())
    each = min(PER_LANG, SAMPLE // max(1, len(sizes)))
    # A hash of the id is uniform: the share below keeps the sample near `each` texts a language.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))]) if sizes else None
    sample: dict[str, list[np.ndarray]] = {}
    if sizes:
        drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            some, packed = [], []
            for i, text in enumerate(batch.column(1)):
                if (found := gram_counts(text.as_py())) is not None:
                    some.append(i)
                    packed.append(np.minimum(found, 65535).astype(np.uint16).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array(packed, pa.binary())], names=["lang", "counts"])

        rows = map_batches(known.where(drawn < share[F.col(lang_col)]).select(lang_col, text_col), count, "lang string, counts binary")
        for r in rows.limit(2 * SAMPLE).collect():
            sample.setdefault(r.lang, []).append(np.frombuffer(r.counts, np.uint16))
    languages = sorted(sample)
    every = np.stack([c for x in languages for c in sample[x]]) if languages else np.zeros((0, BINS), np.uint16)
    idf = np.log((1 + len(every)) / (1 + (every > 0).sum(0))).astype(np.float32) + 1
    model = Model(languages, idf, np.zeros((1, BINS), np.float32), np.zeros(1, np.int64), np.ones(LENGTHS))
    if not languages:
        return model
    vectors = model.vectors(every)
    numbers = np.repeat(np.arange(len(languages)), [len(sample[x]) for x in languages])
    own = [clusters(vectors[numbers == i], CENTROIDS) for i in range(len(languages))]
    model.centroids = np.concatenate(own)
    model.owner = np.repeat(np.arange(len(languages)), [len(c) for c in own])
    cosines, sizes_of = (vectors @ model.centroids.T).max(1), length_class(every)
    usual = [np.percentile(cosines[sizes_of == c], 1) if (sizes_of == c).sum() >= 20 else np.nan for c in range(LENGTHS)]
    # Longer texts come nearer to a centroid: a class without texts takes the floor of the next shorter
    # one, the shortest have none.
    floor = 0.0
    for c, u in enumerate(usual):
        floor = floor if np.isnan(u) else max(floor, REJECT * u)
        model.floor[c] = floor
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and (lang_pred, score, rejected), which replace columns of the same name."""
    docs = without(docs, "lang_pred", "score", "rejected")
    names, at = [*docs.columns, "lang_pred", "score", "rejected"], docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, languages = batch.num_rows, np.array(model.languages, object)
        lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        for s in range(0, n if model.languages else 0, ROWS):
            found = {s + i: c for i, t in enumerate(batch.column(at).slice(s, ROWS)) if (c := gram_counts(t.as_py())) is not None}
            if some := list(found):
                which, score[some], rejected[some] = model.predict(np.stack(list(found.values())))
                lang[some] = languages[which]
        extra = [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    extra = T.StructType.fromDDL("lang_pred string, score double, rejected boolean")
    return map_batches(docs, work, T.StructType([*docs.schema.fields, *extra.fields]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
