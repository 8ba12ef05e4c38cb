"""Language identification by nearest centroids.

A text is the TF-IDF vector of its hashed character n-grams (1 to 3 letters,
a non-letter counts as a space), scaled to length 1. Each language has several
centroids, found by spherical k-means over a bounded sample of its labelled
documents. The nearest centroid by cosine decides; a text farther from it than
any sampled document was from its own language is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import code_points, map_texts
from .common import crc_split

#: Dimensions of the hashed n-gram space.
DIMS = 1 << 13
UNKNOWN = "und"
#: Texts whose vectors are held at once.
ROWS = 64

_letters: np.ndarray | None = None
_fold: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its lower case where that is one code point."""
    global _letters, _fold
    if _letters is None:
        top = 0x110000
        chars = [chr(i) for i in range(0x32000)]
        _letters = np.zeros(top, bool)
        _letters[: len(chars)] = [c.isalpha() for c in chars]
        _fold = np.arange(top, dtype=np.uint32)
        _fold[: len(chars)] = [ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)]
    return _letters, _fold


def count_ngrams(texts: pa.Array):
    """For blocks of texts: counts (rows x DIMS) and the number of letters of each."""
    letters, fold = _tables()
    points, ends = code_points(texts)
    is_letter = letters[points]
    x = np.where(is_letter, fold[points], 0).astype(np.uint32)
    for a in range(0, len(texts), ROWS):
        b = min(len(texts), a + ROWS)
        lo, hi = ends[a], ends[b]
        c, ok = x[lo:hi], is_letter[lo:hi]
        rows = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        n_letters = np.bincount(rows[ok], minlength=b - a)
        # A space before and after each text, so that no n-gram crosses from one text to the next.
        prev, after = np.zeros_like(c), np.zeros_like(c)
        prev[1:], after[:-1] = np.where(rows[1:] == rows[:-1], c[:-1], 0), np.where(rows[1:] == rows[:-1], c[1:], 0)
        c, prev, after, at = c[ok], prev[ok], after[ok], rows[ok] * DIMS
        one = c * np.uint32(2654435761)
        two = one ^ (after * np.uint32(2246822519) + np.uint32(374761393))
        three = two ^ (prev * np.uint32(3266489917) + np.uint32(668265263))
        out = np.zeros((b - a) * DIMS, np.float32)
        for h in (one, two, three):
            out += np.bincount(at + ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(19)), minlength=len(out)).astype(np.float32)
        yield out.reshape(b - a, DIMS), n_letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    #: One row for each centroid, and its language's number.
    centroids: np.ndarray
    owner: np.ndarray
    #: Smallest cosine that each language accepts.
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score (softmax over the languages' cosines) and whether the text is accepted."""
        near = self.vectors(counts) @ self.centroids.T
        best = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1)
        pick = best.argmax(axis=1)
        top = best[np.arange(len(best)), pick]
        share = np.exp((best - top[:, None]) / 0.05).sum(axis=1)
        return pick, 1.0 / share, top >= self.floor[pick]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    centres = x[seeds]
    for _ in range(rounds):
        pick = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[pick == j].mean(axis=0) if (pick == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4, per_lang: int = 400) -> LanguageModel | None:
    """Fit on about ``per_lang`` documents of each language outside the held-out fold, chosen by a hash of the id.

    Every language is learned. The driver gets one sparse vector of at most DIMS
    entries for each sampled document, whatever the lengths of the texts: its
    memory grows with the number of languages, not with the table. None if
    nothing is labelled, as in an empty table.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & (crc_split(id_col) != 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("_h")
    )
    # One row for each language.
    rates = usable.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(1 << 30)) * per_lang / F.count(F.lit(1))).alias("_rate"))
    chosen = usable.join(F.broadcast(rates), (F.col("lang") == F.col("_lang")) & (F.col("_h") < F.col("_rate")))

    def make():
        def sparse(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for counts, n in count_ngrams(texts):
                for row, letters in zip(counts, n, strict=True):
                    at = np.flatnonzero(row) if letters else np.zeros(0, np.int64)
                    rows.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
            return [pa.array(rows, pa.binary())]

        return sparse

    sample = map_texts(chosen, "text", ["lang"], [("v", "binary")], make).collect()
    langs, owner, dense = sorted({r.lang for r in sample}), [], []
    for r in sample:
        n = len(r.v) // 6
        if n:
            row = np.zeros(DIMS, np.float32)
            row[np.frombuffer(r.v[: 2 * n], "<u2")] = np.frombuffer(r.v[2 * n :], "<f4")
            owner.append(langs.index(r.lang))
            dense.append(row)
    if not dense:
        return None
    counts, owner = np.stack(dense), np.array(owner)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    present = sorted(set(owner.tolist()))
    langs, owner = [langs[k] for k in present], np.searchsorted(present, owner)
    centres = [_cluster(x[owner == k], clusters) for k in range(len(langs))]
    # Half of the least cosine seen: texts of the language that are shorter than any in the sample still pass.
    floor = np.array([0.5 * (x[owner == k] @ c.T).max(axis=1).min() for k, c in enumerate(centres)])
    return LanguageModel(langs, idf, np.concatenate(centres).astype(np.float32), np.repeat(np.arange(len(langs)), [len(c) for c in centres]), floor)


def identify(docs: DataFrame, model: LanguageModel | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` and ``lang_pred string, score double, accepted boolean`` for every row.

    A null text or one without a letter is 'und' with score 0 and rejected, as
    is everything without a model. Any other text gets the nearest language,
    also where it is rejected. Ties go to the language that sorts first. Repeated
    rows are each judged; an empty table gives no rows; a carried column that bears
    the name of a result is replaced by it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters * DIMS * 4 bytes for each language

    def make():
        m = shared.value

        def predict(texts: pa.Array) -> list[pa.Array]:
            langs, scores, accepted = [], [], []
            for counts, letters in count_ngrams(texts):
                if m is None:
                    pick, score, ok = np.zeros(len(counts), int), np.zeros(len(counts)), np.zeros(len(counts), bool)
                else:
                    pick, score, ok = m.predict(counts)
                known = (letters > 0) & (m is not None)
                langs += [m.langs[p] if k else UNKNOWN for p, k in zip(pick, known, strict=True)]
                scores.append(np.where(known, score, 0.0))
                accepted.append(ok & known)
            return [pa.array(langs, pa.string()), pa.array(np.concatenate(scores).astype(float)), pa.array(np.concatenate(accepted))]

        return predict

    return map_texts(docs, text_col, carry, [("lang_pred", "string"), ("score", "double"), ("accepted", "boolean")], make)


def keep_accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns.

    Null texts and such without a letter go. Without a model, as where nothing is
    labelled, nothing can be rejected and all rows stay. Columns may have any
    names. An empty table gives no rows.
    """
    if model is None:
        return docs
    names = docs.columns
    inner = docs.toDF(*[f"k{i}" for i in range(len(names))])
    judged = identify(inner, model, inner.columns, f"k{names.index(text_col)}").where("accepted")
    return judged.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)])
