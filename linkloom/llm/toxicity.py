"""Toxicity by a subsequence string kernel support vector machine (operator 1).

A text is a bag of units: its words, lower-cased, without what is no letter
(so ``i.d.i.o.t`` is one unit ``idiot``), digits that stand for letters put
back, runs of single letters joined, and long words cut into overlapping
pieces. The kernel of two units is the gap-weighted subsequence kernel: all
subsequences of ``ORDER`` letters that span at most ``SPAN``, each weighted by
``DECAY`` to its span, normalised. A text's kernel with a landmark unit is the
largest over its units, taken to two powers, a lenient one for gapped and
padded forms and a strict one; Nyström features are these kernels times the
inverse root of the landmarks' own matrix. A squared-hinge support vector
machine is trained on the labelled rows and its margin calibrated to a
probability.

The fit uses a bounded sample of labelled rows (``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN`` of each label, the least hashes of doc_id; one text, the
least, of each doc_id; no text of more than ``LONGEST_SAMPLE`` bytes); scoring
reads every text whole. Letters of any script are letters; two scripts never
share one. Defined cases: null and empty texts score like a text without
units; repeated rows score alike; without a labelled row of each kind every
score is 0; a null doc_id is scored and not held out; extra columns stay in
``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import ENTRY_BYTES, MEMORY_BYTES, giving_back, kept, small_batches, table

ORDER, SPAN, DECAY = 3, 7, 0.75
#: Longest unit; longer words are cut into pieces that overlap by half.
UNIT = 16
LANDMARKS = 200
#: Log-likelihood gain below which a unit's lead in toxic texts may be chance.
LEAST_GAIN = 4.0
POWERS = (5, 16)
#: A kernel below this counts as none.
FLOOR = 0.55
#: Groups of landmarks whose kernels have one upper bound.
GROUPS = 48
SAMPLE_TOXIC, SAMPLE_CLEAN, PADDED = 2500, 4500, 800
#: Bytes of the longest text that is sampled for training: with the numbers above a bound of what the driver gathers.
LONGEST_SAMPLE = 32 << 10
THRESHOLD = 0.7

_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâáãéèêëíîïìóôòõúùûçñœæå"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_STANDS_FOR = str.maketrans("013457@$", "oieastas")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_AT_THE_END = ".,;:!?%&#$*|)\"'"


def units_of_word(word: str) -> list[str]:
    """Units of a white-space separated word."""
    w = word.lower()
    if not w.isalpha():
        bare = w.rstrip(_AT_THE_END)
        if bare.isalpha():  # most words that are not all letters
            w = bare
        else:
            if any(c.isalpha() for c in w):
                w = bare.translate(_STANDS_FOR)
            w = _NOT_LETTER.sub("", w)
    if len(w) <= UNIT:
        return [w] if len(w) >= ORDER else []
    half = UNIT // 2
    return [w[k : k + UNIT] for k in range(0, len(w) - half, half)]


def words_of(text: str | None) -> list[str]:
    """The words of a text, and runs of three or more single letters as one word more."""
    words = text.split() if text else []
    if " " in (text or "") and min(map(len, words), default=9) == 1:
        run: list[str] = []
        more = []
        for w in [*words, "  "]:
            if len(w) == 1 and w.isalnum():
                run.append(w)
            else:
                if len(run) >= 3:
                    more += ["".join(run[k : k + UNIT]) for k in range(0, max(1, len(run) - UNIT // 2), UNIT // 2)]
                run = []
        words = words + more
    return words


@lru_cache(maxsize=32)
def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (rows of three) and weights of a unit of n letters."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(at, np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1.0)).astype(np.float32)


def subsequence_rows(units: list[str], code: dict[str, int] = _CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For units of one length: codes of all their subsequences, the weights, each unit's kernel with itself, and the
    number base of the codes. Letters that ``code`` lacks get numbers above all of its own."""
    at, weight = _subsequences(len(units[0]))
    more: dict[str, int] = {}
    last = len(code) + 1  # no letter's
    c = np.array([[code.get(x) or more.setdefault(x, last + 1 + len(more)) for x in u] for u in units], np.int64)
    base = last + 1 + len(more)
    codes = (c[:, at[:, 0]] * base + c[:, at[:, 1]]) * base + c[:, at[:, 2]]
    order = np.argsort(codes, axis=1)
    flat = (np.arange(len(units))[:, None] * base**3 + np.take_along_axis(codes, order, 1)).ravel()
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    sums = np.add.reduceat(weight[order].ravel(), first)
    own = np.bincount(flat[first] // base**3, sums.astype(np.float64) ** 2, minlength=len(units))
    return codes, weight, own, base


@dataclass
class Landmarks:
    """Units against which the kernel is taken."""

    units: list[str]
    index: np.ndarray | None = field(init=False, default=None)
    weights: np.ndarray = field(init=False)
    #: the largest weight of each code in each group of landmarks
    most: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        #: the letters of landmarks beyond the usual ones get codes too
        extra = sorted(set(chain.from_iterable(self.units)).difference(_CODE))
        self.code = _CODE | {c: len(_CODE) + 1 + i for i, c in enumerate(extra)}
        self.base = len(self.code) + 2
        rows: list[dict[int, float]] = []
        for u in self.units:
            codes, weight, own, _ = subsequence_rows([u], self.code)
            d: dict[int, float] = {}
            for c, w in zip(codes[0].tolist(), weight.tolist()):
                d[c] = d.get(c, 0.0) + w / math.sqrt(own[0])
            rows.append(d)
        known = sorted(set(chain.from_iterable(rows)))
        self.known = np.array(known, np.int64)
        if self.base <= 200:  # a table of all codes stays small
            self.index = np.zeros(self.base**3, np.int32)
            self.index[known] = np.arange(1, len(known) + 1)
        self.weights = np.zeros((len(known) + 1, len(self.units)), np.float32)
        place = {c: i + 1 for i, c in enumerate(known)}
        for k, d in enumerate(rows):
            for c, w in d.items():
                self.weights[place[c], k] = w
        self.letters = np.zeros(max(map(ord, self.code)) + 2, np.int32)  # the last one is any letter that no landmark has
        self.letters[[*map(ord, self.code)]] = [*self.code.values()]
        self.most = np.zeros((len(known) + 1, 1), np.float32)
        if not self.units:
            return
        alike = self.weights.T @ self.weights
        heads = [0]
        while len(heads) < min(GROUPS, len(self.units)):  # the landmark least like all heads so far
            heads.append(int(alike[heads].max(axis=0).argmin()))
        group = alike[heads].argmax(axis=0)
        self.most = np.stack([self.weights[:, group == g].max(axis=1, initial=0) for g in range(len(heads))], axis=1)

    def _bounds(self, units: list[str]) -> tuple[np.ndarray, float]:
        """For units of one length: an upper bound of their kernels with all landmarks before it is divided by the norm
        of the unit, and the least norm that a unit of this length has (that of one whose subsequences all differ)."""
        at, weight = _subsequences(len(units[0]))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), -1)
        c = self.letters[np.minimum(points, len(self.letters) - 1)].astype(np.int64)
        row = self._rows((c[:, at[:, 0]] * self.base + c[:, at[:, 1]]) * self.base + c[:, at[:, 2]], self.base)
        bound = np.zeros((len(units), self.most.shape[1]), np.float32)
        for j, w in enumerate(weight.tolist()):
            bound += w * self.most[row[:, j]]
        return bound.max(axis=1), float(np.sqrt((weight.astype(np.float64) ** 2).sum()))

    def _rows(self, codes: np.ndarray, base: int) -> np.ndarray:
        """Rows of ``weights`` for codes of some base; 0 where a letter is in no landmark."""
        if base != self.base:
            a, b, c = codes // base**2, codes // base % base, codes % base
            codes = np.where(np.maximum(np.maximum(a, b), c) < self.base, (a * self.base + b) * self.base + c, 0)
        if self.index is not None:
            return self.index[codes]
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at + 1, 0)

    def kernels(self, units: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray] | None]:
        """For each unit the landmarks with a kernel of at least ``FLOOR`` and these kernels; None without any."""
        out: dict[str, tuple[np.ndarray, np.ndarray] | None] = dict.fromkeys(units)
        by_size: dict[int, list[str]] = {}
        for u in out:
            by_size.setdefault(len(u), []).append(u)
        usual = self.code.keys()
        for group in by_size.values():
            most: dict[str, float] = {}
            for s in range(0, len(group), 4096):
                part = group[s : s + 4096]
                bound, least = self._bounds(part)
                may = np.flatnonzero(bound >= 0.999 * FLOOR * least)
                most.update(zip([part[i] for i in may.tolist()], bound[may].tolist()))
            # units with other letters are looked up apart, as that takes more steps
            plain = [u for u in most if u.isascii() or usual >= set(u)]
            other = [] if len(plain) == len(most) else [u for u in most if not (u.isascii() or usual >= set(u))]
            for part in (some[s : s + 4096] for some in (plain, other) for s in range(0, len(some), 4096)):
                codes, weight, own, base = subsequence_rows(part, self.code)
                norm = np.sqrt(own)
                may = np.flatnonzero(np.array([most[u] for u in part]) >= 0.999 * FLOOR * norm)
                if not len(may):
                    continue
                near = np.zeros((len(may), len(self.units)), np.float32)
                sub = self._rows(codes[may], base)
                for j, w in enumerate(weight.tolist()):
                    near += w * self.weights[sub[:, j]]
                near /= norm[may][:, None]
                for i in np.flatnonzero((near >= FLOOR).any(axis=1)).tolist():
                    at = np.flatnonzero(near[i] >= FLOOR)
                    out[part[may[i]]] = (at, np.minimum(near[i, at], 1.0))
        return out


class Scorer:
    """Largest kernels of texts with the landmarks, with words remembered."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        #: the words of ``young`` that have kernels
        self.near: set[str] = set()
        self.room = MEMORY_BYTES

    def largest(self, texts: list[str | None]) -> np.ndarray:
        split = [set(words_of(t)) for t in texts]
        lacking = set().union(*split).difference(self.young) if split else set()
        if lacking:
            made: dict[str, tuple | None] = {w: self.old[w] for w in lacking if w in self.old}
            units = {w: units_of_word(w) for w in lacking.difference(made)}
            made.update(dict.fromkeys(units))
            found = {u: h for u, h in self.landmarks.kernels(list(set(chain.from_iterable(units.values())))).items() if h is not None}
            some = set(found)
            for w, parts in units.items():
                if not some.isdisjoint(parts):
                    hits = [found[u] for u in parts if u in some]
                    made[w] = hits[0] if len(hits) == 1 else (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
            if self.room < 0:  # what this batch needs of the old words stays at hand
                young = self.young
                self.old, self.young = young, {w: young[w] for words in split for w in words if w in young}
                self.near.intersection_update(self.young)
                self.room = MEMORY_BYTES
            near = [w for w, h in made.items() if h is not None]
            self.room -= ENTRY_BYTES * (len(made) + len(near)) + sum(map(len, made))
            self.near.update(near)
            self.young.update(made)
        out = np.zeros((len(texts), len(self.landmarks.units)), np.float32)
        young = self.young
        for i, words in enumerate(split):
            hits = [young[w] for w in words & self.near]
            if hits:
                np.maximum.at(out[i], np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
        return out


@dataclass
class Model:
    """Landmarks, Nyström maps, the machine's weights, and the calibration."""

    landmarks: Landmarks | None
    maps: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def features(self, largest: np.ndarray) -> np.ndarray:
        return np.concatenate([largest.astype(np.float64) ** p @ m for p, m in zip(POWERS, self.maps)], axis=1)

    def scores(self, largest: np.ndarray) -> np.ndarray:
        a, b = self.scale
        z = a * (self.features(largest) @ self.weights + self.bias) + b
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def choose_landmarks(texts: list[str | None], y: np.ndarray) -> list[str]:
    """Units that toxic texts have more often than clean ones, by likelihood ratio."""
    toxic, clean = Counter(), Counter()
    for t, label in zip(texts, y):
        units = set(chain.from_iterable(map(units_of_word, set(words_of(t)))))
        (toxic if label else clean).update(units)
    nt, nc = int(y.sum()) + 1, int((1 - y).sum()) + 1
    gain = lambda u: toxic[u] * math.log((toxic[u] / nt) / ((toxic[u] + clean[u]) / (nt + nc)))
    ranked = sorted((u for u in toxic if toxic[u] / nt > clean[u] / nc), key=lambda u: (-gain(u), u))[:LANDMARKS]
    sure = [u for u in ranked if gain(u) >= LEAST_GAIN]
    return sure if len(sure) >= 10 else ranked[:10]


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient descent; classes weigh alike."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * c
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    reg = np.full(z.shape[1], 1e-3)
    reg[-1] = 0
    w = v = np.zeros(z.shape[1])
    rate = 1 / (2 * np.linalg.norm(z * np.sqrt(share)[:, None], 2) ** 2 + 1e-3)
    for k in range(steps):
        slack = np.maximum(0, 1 - sign * (z @ v))
        new = v - rate * (reg * v - 2 * z.T @ (share * sign * slack))
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Platt), by Newton steps; classes weigh alike, since toxic rows are rare."""
    share = np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y <= 0).sum()))
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
        g = np.array([(share * (p - target) * f).sum() + 1e-3 * a, (share * (p - target)).sum()])
        s = share * (p * (1 - p) + 1e-9)
        h = np.array([[(s * f * f).sum() + 1e-3, (s * f).sum()], [(s * f).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(max(a, 1e-3)), float(b)


def padded(text: str, marks: set[str], seed: int) -> str:
    """A text whose landmark words each have one letter more somewhere inside."""
    out = []
    for k, w in enumerate(text.split()):
        u = _NOT_LETTER.sub("", w.lower())
        if u in marks and len(u) > ORDER:
            at = 1 + (seed * 31 + k * 7) % (len(u) - 1)
            w = u[:at] + "abcdefghijklmnopqrstuvwxyz"[(seed * 17 + k * 5) % 26] + u[at:]
        out.append(w)
    return " ".join(out)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Train on labelled texts; every fifth text calibrates.

    Some toxic texts come once more with padded landmark words, so that the
    machine learns to weigh the lenient kernel too; empty texts count as clean.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None)
    marks = Landmarks(choose_landmarks(texts, y))
    bad = set(marks.units)
    more = [padded(t, bad, k) for k, (t, label) in enumerate(zip(texts, labels)) if label and t and k % 5][:PADDED]
    empty = int((y == 0).sum()) // 20 + 1
    texts, y = [*texts, *more, *[""] * empty], np.concatenate([y, np.ones(len(more), np.int64), np.zeros(empty, np.int64)])
    scorer = Scorer(marks)
    largest = np.concatenate([scorer.largest(texts[k : k + 256]) for k in range(0, len(texts), 256)])  # a few texts' words at once
    own = Scorer(marks).largest(marks.units).astype(np.float64)
    own = (own + own.T) / 2
    np.fill_diagonal(own, 1)
    model = Model(marks)
    for p in POWERS:
        values, vectors = np.linalg.eigh(own**p)
        model.maps.append(vectors / np.sqrt(np.maximum(values, 0.05)) @ vectors.T)
    x = model.features(largest)
    held = (np.arange(len(y)) % 5 == 0) & (np.arange(len(y)) < len(labels))
    if y[held].sum() < 40 or len(set(y[held])) < 2:  # too few to spare
        held[:] = False
    model.weights, model.bias = train_svm(x[~held], y[~held])
    at = held if held.any() else ~held
    model.scale = calibrate(x[at] @ model.weights + model.bias, y[at])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str | None], list[int]]:
    """The bounded sample of labelled rows, without the held-out ones, in the order of their hashes."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).withColumn("lot", F.xxhash64("doc_id"))
    parts = [rows.where(F.col("toxic") == k).orderBy("lot", "doc_id").limit(n) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = parts[0].unionByName(parts[1])
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows are broadcast and gathered
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST_SAMPLE)
    got = short.join(F.broadcast(chosen), "doc_id").groupBy("lot", "doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r["lot"], r["doc_id"], r["toxic"]))
    return [r["text"] for r in got], [r["toxic"] for r in got]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    schema = "doc_id long, score double"
    key = hash(tuple(model.landmarks.units)) if model.landmarks else 0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text_scores(model, key, b.column("text").to_pylist()))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def text_scores(model: Model, key: int, texts: list[str | None]) -> np.ndarray:
    if model.landmarks is None:
        return np.zeros(len(texts))
    return model.scores(kept("toxicity", str(key), lambda: Scorer(model.landmarks)).largest(texts))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts that score ``THRESHOLD`` or more; all columns stay."""
    key = hash(tuple(model.landmarks.units)) if model.landmarks else 0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(text_scores(model, key, b.column("text").to_pylist()) < THRESHOLD))

    return docs.mapInArrow(giving_back(run), docs.schema)


def op1_ssk_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(*training_rows(docs, table(spark, sf_dir, "labels"))))
