"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel compares two strings by the subsequences of 4 letters that they
share, within a span of at most 7; each letter that a subsequence skips costs a
factor. An insult with gaps or inserted characters thus still meets its plain
form. Landmarks are words of labelled documents; the Nyström map takes a window
of text to its kernel values with them, whitened, and a linear support vector
machine separates windows of toxic sentences from those of clean ones.

Both maps are linear in the subsequences, so the trained model is one table of
2^20 weights (4 letters of 5 bits), and a text's margin is the largest sum of
them in any window.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import code_points, map_texts
from .common import crc_split

SPAN, DECAY, WINDOW = 7, 0.8, 12
#: Offsets of the 2nd to 4th letter, and the factor for what they skip.
SUBSEQUENCES = [(o, DECAY ** (o[-1] - 3)) for o in itertools.combinations(range(1, SPAN), 3)]
CODES = 1 << 20
#: The code of what stands between words; it takes part in subsequences, so that a short word has more than its letters.
GAP = 28
#: Letters that count as a sentence of a clean text in training.
SENTENCE = 200
#: Characters that stand for letters beside a letter: fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_code: np.ndarray | None = None
_alike: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The code of each code point: 1-26 for a-z less accents, 27 for other letters, 0 for the rest; and lookalikes' codes."""
    global _code, _alike
    if _code is None:
        _code, _alike = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
        for i in range(0x32000):
            if (c := chr(i)).isalpha():
                base = unicodedata.normalize("NFKD", c)[0].lower()
                _code[i] = ord(base) - 96 if "a" <= base <= "z" else 27
        for a, b in LOOKALIKES.items():
            _alike[ord(a)] = ord(b) - 96
    return _code, _alike


def letter_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts in a row, each between two GAPs and followed by zeros, WINDOW with the second GAP; where each begins.

    Runs of other characters become one GAP, and none between letters that
    stand alone: spelled-out words are joined.
    """
    code, alike = _tables()
    points, ends = code_points(texts)
    n = len(texts)
    x = np.zeros(len(points) + n * WINDOW, np.uint8)
    raw = np.zeros(len(x), np.uint8)
    at = np.arange(len(points)) + np.repeat(np.arange(n), np.diff(ends)) * WINDOW
    x[at], raw[at] = code[points], alike[points]
    near = np.zeros(len(x), bool)
    near[1:] |= x[:-1] > 0
    near[:-1] |= x[1:] > 0
    x = np.where((raw > 0) & near, raw, x)
    end = np.zeros(len(x), bool)  # the zeros after each text stay
    stop = ends[1:] + np.arange(n) * WINDOW
    end[(stop[:, None] + np.arange(WINDOW)).reshape(-1)] = True
    zero = x == 0
    doubled = np.zeros(len(x), bool)
    doubled[1:] = zero[1:] & zero[:-1] & ~end[1:]
    kept = np.flatnonzero(~doubled)
    x, end = x[kept], end[kept]
    starts = np.searchsorted(kept, ends[:-1] + np.arange(n) * WINDOW)
    zero = x == 0
    alone = ~zero
    alone[1:] &= zero[:-1]
    alone[:-1] &= zero[1:]
    joint = np.zeros(len(x), bool)
    joint[1:-1] = zero[1:-1] & alone[:-2] & alone[2:] & ~end[1:-1]
    shift = np.cumsum(joint)
    starts = starts - np.where(starts > 0, shift[np.maximum(starts - 1, 0)], 0)
    x, end = x[~joint], end[~joint]
    x[(x == 0) & ~end] = GAP
    if n:
        x[np.append(starts[1:], len(x)) - WINDOW] = GAP
    return np.insert(x, starts, GAP), starts + np.arange(n)


def _features(x: np.ndarray):
    """For each kind of subsequence: its number at each position (0 where it has a zero), and its weight."""
    y = np.concatenate([x, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    n = len(x)
    lead = y[:n] << 15
    dead = x == 0
    for (a, b, c), weight in SUBSEQUENCES:
        p, q, r = y[a : a + n], y[b : b + n], y[c : c + n]
        number = lead | p << 10 | q << 5 | r
        number[dead | (p == 0) | (q == 0) | (r == 0)] = 0
        yield number, weight


def window_sums(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The model's sum over the WINDOW positions from each position on. ``table`` is 0 wherever a code is."""
    y = np.concatenate([x, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    n = len(x)
    s = np.zeros(n, np.float32)
    lead, second, third = y << 15, y << 10, y << 5
    for (a, b, c), weight in SUBSEQUENCES:
        number = lead[:n] | second[a : a + n]
        number |= third[b : b + n]
        number |= y[c : c + n]
        s += np.float32(weight) * table[number]
    total = np.zeros(n + WINDOW, np.float64)
    np.cumsum(s, out=total[1 : n + 1])
    total[n + 1 :] = total[n]
    return (total[WINDOW : WINDOW + n] - total[:n]).astype(np.float32)


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray
    bias: float
    #: Platt's sigmoid over a text's margin.
    slope: float
    offset: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        x, starts = letter_stream(texts)
        # Windows begin inside the text: from the zeros after it they would reach the next one.
        stops = np.maximum(np.append(starts[1:], len(x)) - WINDOW, starts + 1)
        return np.maximum.reduceat(window_sums(x, self.table), np.stack([starts, stops], axis=1).reshape(-1))[::2] + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge, classes weighted alike, by Newton steps; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    c = cost * np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * 100
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    value = lambda w: 0.5 * w @ ridge @ w + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = ridge @ w - 2 * x[on].T @ (c[on] * y[on] * slack[on])
        step = np.linalg.solve(ridge + 2 * (x[on].T * c[on]) @ x[on], grad)
        t, now = 1.0, value(w)
        while t > 1e-4 and value(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-7:
            break
    return w


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid, with his smoothed targets."""
    p, n = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    x = np.stack([m, np.ones_like(m)], axis=1).astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), x.T @ (q - t) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -5, 5)
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: list[str], toxic: list[int], landmarks: int = 224, background: int = 64, rounds: int = 3) -> ToxicityModel:
    """Train on labelled texts. A sentence of a clean text is clean; of a toxic text, its worst sentence is toxic."""
    y = np.where(np.array(toxic) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(np.zeros(CODES, np.float32), 0.0, 0.0, -50.0 if not (y > 0).any() else 50.0)
    n_pos, n_neg = (y > 0).sum(), (y < 0).sum()

    def words(text: str) -> set[str]:
        return {w for w in re.findall(r"[^\W\d_]+", text.lower()) if 3 < len(w) <= 24}

    # Candidates come from toxic texts; clean ones count only these, so that the clean vocabulary takes no memory.
    bad: Counter[str] = Counter()
    full: Counter[str] = Counter()
    for t in (t for t, label in zip(texts, y.tolist(), strict=True) if label > 0):
        own = words(t)
        bad.update(own | {w[:k] for w in own for k in (4, 5, 6)})  # stems, too
        full.update(own)
    bad = Counter({w: k for w, k in bad.items() if k > 2 or n_pos < 100})
    stems = {w for w in bad if full[w] < bad[w]}
    del full
    good: Counter[str] = Counter()
    usual: Counter[str] = Counter()
    for i, t in enumerate(t for t, label in zip(texts, y.tolist(), strict=True) if label < 0):
        own = words(t)
        good.update(w for w in own | {w[:k] for w in own for k in (4, 5, 6)} if w in bad)
        if i < 300:
            usual.update(own)
    odds = {w: (np.log((k + 0.5) / (n_pos + 1)) - np.log((good[w] + 0.5) / (n_neg + 1))) * k**0.5 for w, k in bad.items()}
    marks = sorted(odds, key=lambda w: (-odds[w], w))[:landmarks]
    marks += [w for w, _ in sorted(usual.items(), key=lambda i: (-i[1], i[0])) if w not in set(marks)][:background]
    # Landmarks as rows of subsequence weights over the subsequences that any of them has.
    x, starts = letter_stream(pa.array(marks, pa.string()))
    # Stems have no gap after them.
    whole = np.array([w in usual or w not in stems for w in marks])
    ends = np.append(starts[1:], len(x)) - WINDOW
    x[ends[~whole]] = 0
    owner = np.searchsorted(starts, np.arange(len(x)), side="right") - 1
    number, who, weight = (np.concatenate(v) for v in zip(*[(f[f > 0], owner[f > 0], np.full((f > 0).sum(), w)) for f, w in _features(x)], strict=True))
    known, column = np.unique(number, return_inverse=True)
    rows = np.zeros((len(marks), len(known) + 1), np.float32)
    np.add.at(rows, (who, column), weight)
    size = np.maximum(np.linalg.norm(rows, axis=1), 1e-9)
    rows /= size[:, None]
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    good = values > 1e-3 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    place = np.full(CODES, len(known), np.int32)  # the last column is empty
    place[known] = np.arange(len(known))
    place[0] = len(known)

    stream, begin = letter_stream(pa.array(texts, pa.string()))
    stops = np.maximum(np.append(begin[1:], len(stream)) - WINDOW, begin + 1)
    table = np.zeros(CODES, np.float32)
    strength = np.array([odds[w] if i < landmarks and w in odds else 0.0 for i, w in enumerate(marks)])
    lean = (strength / max(strength.max(), 1e-9)) ** 2 / size  # a whole word counts alike, short or long
    table[known] = (lean @ rows)[:-1]
    bias = 0.0
    # Sentences of toxic texts that look worse than nearly all clean texts do count as toxic beside the worst one.
    sums = window_sums(stream, table)
    calm = np.quantile([sums[a:b].max() for a, b, mark in zip(begin.tolist(), stops.tolist(), y.tolist(), strict=True) if mark < 0], 0.995)
    plain = []
    for a, b in zip(begin[y > 0].tolist(), stops[y > 0].tolist(), strict=True):
        peaks = [lo + int(sums[lo : min(b, lo + SENTENCE // 4)].argmax()) for lo in range(a, b, SENTENCE // 4)]
        plain += [i for i in peaks if sums[i] > calm]
    by_column = np.ascontiguousarray(rows.T)
    padded = np.concatenate([stream, np.zeros(2 * WINDOW, np.uint8)])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        sums = window_sums(stream, table)
        worst, label = list(plain), [1] * len(plain)
        for a, b, mark in zip(begin.tolist(), stops.tolist(), y.tolist(), strict=True):
            worst.append(a + int(sums[a:b].argmax()))
            label.append(mark)
            if mark < 0:  # more sentences of a clean text
                lows = range(a, b, SENTENCE)
                more = sorted((lo + int(sums[lo : min(b, lo + SENTENCE)].argmax()) for lo in lows), key=lambda i: (-sums[i], i))[1:4]
                worst += more
                label += [-1] * len(more)
        windows, label = padded[np.array(worst)[:, None] + np.arange(WINDOW + SPAN)], np.array(label)
        # Toxic windows once more with a character or a gap put in.
        broken = windows[label > 0]
        cut_at = rng.integers(1, WINDOW - 1, len(broken))[:, None]
        place_at = np.arange(broken.shape[1])[None, :]
        broken = np.where(place_at <= cut_at, broken, np.roll(broken, 1, axis=1))
        np.put_along_axis(broken, cut_at, rng.choice([GAP, *range(1, 27)], cut_at.shape, p=[0.5] + [0.5 / 26] * 26).astype(np.uint8), axis=1)
        windows, label = np.concatenate([windows, broken]), np.concatenate([label, np.ones(len(broken), int)])
        near = np.zeros((len(windows), rows.shape[0]), np.float32)
        for lo in range(0, len(windows), 2000):
            part = windows[lo : lo + 2000].astype(np.int32)
            for o, w in SUBSEQUENCES:
                p = [part[:, k : k + WINDOW] for k in (0, *o)]
                number = p[0] << 15 | p[1] << 10 | p[2] << 5 | p[3]
                number[(p[0] == 0) | (p[1] == 0) | (p[2] == 0) | (p[3] == 0)] = 0
                columns = place[number]
                hit = np.flatnonzero((columns < len(known)).any(axis=0))
                for j in hit.tolist():
                    near[lo : lo + 2000] += np.float32(w) * by_column[columns[:, j]]
        w = _svm(near @ whiten, label.astype(float))
        table = np.zeros(CODES, np.float32)
        table[known] = (rows.T @ (whiten @ w[:-1]))[:-1]
        bias = float(w[-1])
    margins = np.array([window_sums(stream[a:b], table).max() for a, b in zip(begin.tolist(), stops.tolist(), strict=True)]) + bias
    return ToxicityModel(table, bias, *_logistic(margins, y))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, max_bytes: int = 20_000) -> ToxicityModel | None:
    """Fit on about ``per_class`` toxic and as many clean labelled documents outside the held-out fold, of at most ``max_bytes`` each.

    They are chosen by a hash of the id. None if no label is known.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (crc_split(id_col) != 0)).select(F.col(id_col).alias("id"), F.col("toxic").alias("y"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h"))
    sizes = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if not sizes:
        return None
    chosen = F.lit(False)
    for k, n in sizes.items():
        chosen = chosen | ((F.col("y") == k) & (F.col("h") < int((1 << 30) * min(1.0, per_class / n))))
    picked = usable.where(chosen).groupBy("id").agg(F.max("y").alias("y"))  # about 2 * per_class rows
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(picked), "id")
        .select("id", "text", "y")
        .collect()
    )
    rows.sort(key=lambda r: (r.id, r.text))
    return fit([r.text for r in rows], [r.y for r in rows]) if rows else None


def score(docs: DataFrame, model: ToxicityModel | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for every row, from its whole text alone.

    A null or empty text gets the score of a text without letters. Without a
    model all scores are 0. Repeated rows get the same score; an empty table
    gives no rows; a carried column that bears the name of a result is replaced
    by it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of 4 MB

    def make():
        m = shared.value

        def run(texts: pa.Array) -> list[pa.Array]:
            p = m.probability(m.margins(texts)) if m is not None else np.zeros(len(texts))
            return [pa.array(p.astype(float)), pa.array((p >= 0.5).astype(np.int32))]

        return run

    return map_texts(docs, text_col, carry, [("score", "double"), ("predicted", "int")], make)
