"""Operator 10: toxicity by a bidirectional gated recurrent network.

Each word enters as its own embedding (words seen in enough training texts;
one shared row for all others) joined with two embeddings of its characters:
the mean over its bytes by value and place, and the mean over its beginnings
of 1 to ``LONGEST`` bytes (those seen in enough training texts).  A forward and a backward gated
recurrent layer read a window of ``WINDOW`` words, attention pools their
states, and a logistic unit scores the window.  A text's score is a logistic
function, fitted on the training texts, of its highest window, its three
highest windows, all its overlapping windows, and how many there are.

Training runs in numpy on the driver over a documented, bounded sample of
labelled rows (``MAX_TOXIC`` + ``MAX_CLEAN`` whole texts of ``MAX_CHARS`` code
points a class; texts of over ``MAX_TEXT`` code points only where shorter ones
don't fill it): first every window bears
the label of its text, then only the highest windows of toxic texts do.  The
model's size is fixed; scoring runs in tasks, over every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_batches, scratch_table, text_runs, whole_text
from .words import Words

WINDOW, STRIDE = 32, 16
#: Bounds of the training sample: labelled texts of each class, and code points of each class.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 800, 1200, 2_500_000
#: Code points up to which texts are picked by hash; longer ones come after them, the shortest first.
MAX_TEXT = 25_000
HIDDEN, WORD_DIM, CHAR_DIM, STEM_DIM, ATTENTION = 12, 12, 6, 12, 8
LONGEST = 9                                   # bytes of a word's longest beginning
PLACES = 8                                    # places of a byte in its word: 0..6, later
MIN_TEXTS = 4                                 # training texts a word must be in to have an own row
MAX_WORDS = MAX_STEMS = 20_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all overlapping windows: every ``STRIDE``
    words until the end is covered; a text without words has one empty window."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = k * STRIDE
    return text, first, np.minimum(WINDOW, counts[text] - first)


@dataclass
class Model:
    """Parameters (float32) and the calibration of text scores."""

    vocabulary: np.ndarray                    # sorted word hashes with own rows (row = place + 1)
    stems: np.ndarray                         # the same for beginnings of words
    p: dict[str, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None         # calibration of a text's window figures
    constant: float | None = None             # score of every text if a class has no training rows

    @classmethod
    def fresh(cls, vocabulary: np.ndarray, stems: np.ndarray, rng: np.random.Generator) -> "Model":
        d, h = WORD_DIM + CHAR_DIM + STEM_DIM, HIDDEN
        shapes = {"word": (len(vocabulary) + 1, WORD_DIM), "char": (256 * PLACES, CHAR_DIM), "stem": (len(stems) + 1, STEM_DIM),
                  "wf": (d, 3 * h), "wb": (d, 3 * h), "uf": (h, 3 * h), "ub": (h, 3 * h),
                  "bf": (3 * h,), "bb": (3 * h,), "aw": (2 * h, ATTENTION), "ab": (ATTENTION,), "av": (ATTENTION,),
                  "ow": (2 * h,), "ob": (1,)}
        p = {}
        for k, s in shapes.items():
            wide = {"word": 0.5, "char": 0.5, "stem": 0.5}.get(k, 1.0 / np.sqrt(s[0]))
            p[k] = np.zeros(s, np.float32) if len(s) == 1 and k != "av" and k != "ow" else (
                rng.standard_normal(s) * wide).astype(np.float32)
        return cls(vocabulary, stems, p)

    # -- inputs -----------------------------------------------------------------
    @staticmethod
    def rows_of(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at + 1, 0)

    # -- forward ----------------------------------------------------------------
    def _scan(self, x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each step; ``x``: (steps, n, 3h) input parts; ``mask``: (steps, n, 1)."""
        steps, n, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            g = h @ u
            zr = _sigmoid(x[t, :, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            new = c + z * (h - c)
            if mask is not None:
                new = np.where(mask[t], new, h)
            if keep is not None:
                keep.append((h, g[:, 2 * HIDDEN:], z, r, c))
            h = out[t] = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        """Attention over the states: (weights, hidden layer, pooled)."""
        a = np.tanh(states @ self.p["aw"] + self.p["ab"])
        e = a @ self.p["av"]
        if mask is not None:
            e = np.where(mask[:, :, 0], e, -30.0)
        w = np.exp(e - e.max(0))
        if mask is not None:
            w = w * mask[:, :, 0]
        w = w / np.maximum(w.sum(0), 1e-9)
        return w, a, np.einsum("tn,tnd->nd", w, states)

    def score_windows(self, parts: np.ndarray, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits; ``parts``: input parts of both directions by distinct word; ``at``: (steps, n) rows of it."""
        f = self._scan(parts[0][at], mask, self.p["uf"], None)
        b = self._scan(parts[1][at[::-1]], None if mask is None else mask[::-1], self.p["ub"], None)[::-1]
        _, _, pooled = self.pool(np.concatenate([f, b], 2), mask)
        return pooled @ self.p["ow"] + self.p["ob"]

    def inputs(self, words: Words) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Input parts of both directions per distinct word, and each word's row.
        Row 0 stands for no word."""
        distinct, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        x = np.concatenate([self.p["word"][self.rows_of(self.vocabulary, distinct)], self.char_means(words, where),
                            self.stem_means(words, where)], 1)
        x = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
        return (x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]), back + 1

    def char_cells(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (byte, place) of the chosen words, flat, and where each word's begin."""
        sizes = words.sizes[which]
        begins = np.cumsum(sizes) - sizes
        flat = np.repeat(words.first[which] - begins, sizes) + np.arange(int(sizes.sum()))
        return words.letters[flat].astype(np.int64) * PLACES + np.minimum(words.position[flat], PLACES - 1), begins

    def char_means(self, words: Words, which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros((0, CHAR_DIM), np.float32)
        cells, begins = self.char_cells(words, which)
        return np.add.reduceat(self.p["char"][cells], begins, 0) / words.sizes[which][:, None].astype(np.float32)

    def stem_cells(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the beginnings of the chosen words, flat, and how many each word has."""
        hashes, n = words.beginnings(which, LONGEST)
        return self.rows_of(self.stems, hashes), n

    def stem_means(self, words: Words, which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros((0, STEM_DIM), np.float32)
        cells, n = self.stem_cells(words, which)
        return np.add.reduceat(self.p["stem"][cells], np.cumsum(n) - n, 0) / n[:, None].astype(np.float32)

    # -- whole texts ------------------------------------------------------------
    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of all windows of all texts."""
        text, first, size = windows(words.counts())
        parts, row = self.inputs(words)
        out = np.empty(len(text), np.float32)
        start = words.bounds[text] + first
        step = np.arange(WINDOW)[:, None]
        for group, masked in ((np.flatnonzero(size == WINDOW), False), (np.flatnonzero(size < WINDOW), True)):
            for i in range(0, len(group), 4096):
                g = group[i: i + 4096]
                if masked:
                    mask = (step < size[g])[:, :, None]
                    at = np.where(mask[:, :, 0], row[np.minimum(start[g] + step, len(row) - 1)], 0) if len(row) else np.zeros(
                        (WINDOW, len(g)), np.int64)
                    out[g] = self.score_windows(parts, at, mask)
                else:
                    out[g] = self.score_windows(parts, row[start[g] + step], None)
        return text, out

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores 0 to 1 of whole texts."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        for lo, hi in text_runs(texts):
            x = figures(*self.window_logits(Words(texts[lo:hi])), hi - lo)
            out[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        return out


def figures(text: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """What is known of each text from its windows' logits: the highest, the
    mean of the three highest, the mean, the logarithm of their number, 1.
    Every text has a window."""
    order = np.lexsort((-logit, text))
    count = np.bincount(text, minlength=n)
    begin = np.cumsum(count) - count
    ranked = logit[order].astype(np.float64)
    top = [ranked[begin + np.minimum(k, count - 1)] for k in range(3)]
    mean = np.bincount(text, np.clip(logit, -8, 8), n) / count
    return np.stack([np.clip(top[0], -8, 8), np.clip((top[0] + top[1] + top[2]) / 3, -8, 8), mean, np.log(count), np.ones(n)], 1)


# -- training -------------------------------------------------------------------
class _Adam:
    """Adam; embedding tables are stepped only in the rows a batch touched."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.rate, self.t = rate, 0

    def step(self, p: dict[str, np.ndarray], grads: dict) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * g * g
            p[k][rows] -= (self.rate * fix * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


def _scan_back(d_out: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input parts and of ``u``."""
    steps, n, _ = d_out.shape
    dh = np.zeros((n, HIDDEN), np.float32)
    dx = np.empty((steps, n, 3 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, gn, z, r, c = kept[t]
        dh = dh + d_out[t]
        live = dh * mask[t]
        dc = live * (1 - z) * (1 - c * c)
        dz = live * (h - c) * z * (1 - z)
        dr = dc * gn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], 1)
        dg = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ dg
        dh = dh * (1 - mask[t]) + live * z + dg @ u.T
    return dx, du


def _sums(rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, sums of the rows of each)."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return place[cut], np.add.reduceat(rows[order], cut, 0)


def _gradients(m: Model, words: Words, first_of: np.ndarray, kind: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict:
    """Gradients of the log loss over windows; ``kind``: (steps, n) numbers of
    distinct words, ``first_of``: a place in ``words`` of each."""
    p, steps, n = m.p, *kind.shape
    mf = mask.astype(np.float32)
    distinct, back = np.unique(kind.ravel(), return_inverse=True)
    which = first_of[distinct]
    rows = m.rows_of(m.vocabulary, words.hashes[which])
    cells, begins = m.char_cells(words, which)
    sizes = words.sizes[which]
    stems, n_stems = m.stem_cells(words, which)
    each = np.concatenate([p["word"][rows], np.add.reduceat(p["char"][cells], begins, 0) / sizes[:, None].astype(np.float32),
                           np.add.reduceat(p["stem"][stems], np.cumsum(n_stems) - n_stems, 0) / n_stems[:, None].astype(np.float32)], 1)
    x = each[back] * mf.reshape(-1, 1)
    xs = x.reshape(steps, n, -1)
    kf, kb = [], []
    f = m._scan(xs @ p["wf"] + p["bf"], mask, p["uf"], kf)
    b = m._scan((xs @ p["wb"] + p["bb"])[::-1], mask[::-1], p["ub"], kb)[::-1]
    states = np.concatenate([f, b], 2)
    w, a, pooled = m.pool(states, mask)
    y = _sigmoid(pooled @ p["ow"] + p["ob"])
    d = ((y - target) / n).astype(np.float32)
    g = {"ow": pooled.T @ d, "ob": d.sum(keepdims=True)}
    dp = d[:, None] * p["ow"]
    dstates = w[:, :, None] * dp
    dw = np.einsum("tnd,nd->tn", states, dp)
    de = w * (dw - (w * dw).sum(0))
    g["av"] = np.einsum("tn,tnk->k", de, a)
    da = de[:, :, None] * p["av"] * (1 - a * a)
    g["aw"] = np.einsum("tnd,tnk->dk", states, da)
    g["ab"] = da.sum((0, 1))
    dstates = dstates + da @ p["aw"].T
    dxf, g["uf"] = _scan_back(np.ascontiguousarray(dstates[:, :, :HIDDEN]), kf, mf, p["uf"])
    dxb, g["ub"] = _scan_back(np.ascontiguousarray(dstates[::-1, :, HIDDEN:]), kb, mf[::-1], p["ub"])
    dxb = dxb[::-1]
    flat = x.reshape(steps * n, -1)
    ff, fb = dxf.reshape(steps * n, -1), dxb.reshape(steps * n, -1)
    g["wf"], g["wb"], g["bf"], g["bb"] = flat.T @ ff, flat.T @ fb, ff.sum(0), fb.sum(0)
    dx = (ff @ p["wf"].T + fb @ p["wb"].T) * mf.reshape(-1, 1)
    dx = _sums(dx, back)[1]                               # by distinct word
    c = WORD_DIM + CHAR_DIM
    g["word"] = _sums(dx[:, :WORD_DIM], rows)
    g["char"] = _sums(np.repeat(dx[:, WORD_DIM:c] / sizes[:, None], sizes, 0), cells)
    g["stem"] = _sums(np.repeat(dx[:, c:] / n_stems[:, None], n_stems, 0), stems)
    return g


def _texts_with(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, number of texts each is in)."""
    order = np.lexsort((owner, hashes))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.unique(h[new], return_counts=True)


def _frequent(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
    """Hashes found in at least ``MIN_TEXTS`` training texts (the most frequent ones), sorted."""
    seen, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(seen))
    best = np.lexsort((seen, -n))[:most]
    return np.sort(seen[best][n[best] >= MIN_TEXTS])


def _vocabularies(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings of words with own rows, counted a block of texts at a time."""
    counts, own, stems = words.counts(), [], []
    for lo in range(0, len(counts), 100):
        hi = min(lo + 100, len(counts))
        a, b = words.bounds[lo], words.bounds[hi]
        owner = np.repeat(np.arange(lo, hi), counts[lo:hi])
        own.append(_texts_with(words.hashes[a:b], owner))
        hashes, n = words.beginnings(np.arange(a, b), LONGEST)
        stems.append(_texts_with(hashes, np.repeat(owner, n)))
    return _frequent(own, MAX_WORDS), _frequent(stems, MAX_STEMS)


def train(texts: list[str], labels: np.ndarray, *, steps: int = 250, batch: int = 256, seed: int = 7) -> Model:
    """Fits the network to labelled texts."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.empty(0, np.uint64), np.empty(0, np.uint64), constant=float(labels[0]) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    words = Words(texts)
    m = Model.fresh(*_vocabularies(words), rng)
    text, first, size = windows(words.counts())
    filled = size > 0
    text, start, size = text[filled], (words.bounds[text] + first)[filled], size[filled]
    is_toxic = labels[text] > 0
    if not is_toxic.any() or is_toxic.all():
        return Model(np.empty(0, np.uint64), np.empty(0, np.uint64), constant=float(labels.mean()))
    toxic, clean = np.flatnonzero(is_toxic), np.flatnonzero(~is_toxic)
    adam = _Adam(m.p, 0.02)
    step = np.arange(WINDOW)[:, None]
    mine, clean_now = np.flatnonzero(is_toxic), clean
    _, first_of, kinds = np.unique(words.hashes, return_index=True, return_inverse=True)
    for k in range(steps):
        if k and k % (steps // 5) == 0:                   # the highest windows of clean texts, and in the end of toxic ones
            logit = m.window_logits(words)[1][filled]
            hard = clean[np.argsort(-logit[clean], kind="stable")[: len(clean) // 8 + 1]]
            clean_now = np.concatenate([clean, np.repeat(hard, 8)])
            if k >= 2 * (steps // 5):
                best = np.full(len(labels), -np.inf)
                np.maximum.at(best, text[mine], logit[mine])
                toxic = mine[logit[mine] >= best[text[mine]] - 1.0]
        adam.rate = 0.02 if k < 3 * steps // 5 else 0.006
        pick = np.concatenate([rng.choice(toxic, batch // 2), rng.choice(clean_now, batch // 2)])
        mask = (step < size[pick])[:, :, None]
        at = np.minimum(start[pick] + step, len(words.hashes) - 1)
        target = np.where(is_toxic[pick], 0.97, 0.01).astype(np.float32)
        adam.step(m.p, _gradients(m, words, first_of, kinds[at], mask, target))
    _calibrate(m, words, labels)
    return m


def _calibrate(m: Model, words: Words, labels: np.ndarray) -> None:
    """Logistic fit (ridge, damped Newton steps) of the labels to the window figures of the training texts."""
    x = figures(*m.window_logits(words), len(labels))

    def loss(w: np.ndarray) -> float:
        s = x @ w
        return float((np.logaddexp(0, s) - labels * s).sum() + 0.5 * (w @ w))

    w = np.zeros(x.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.eye(len(w)), x.T @ (q - labels) + w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w - step
    m.weights = w


# -- operator -------------------------------------------------------------------
def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS, max_text: int = MAX_TEXT) -> Model:
    """Trains on at most ``max_toxic`` + ``max_clean`` labelled texts outside
    the held-out rows, as far as those of a class hold ``max_chars`` code
    points (one text at least).

    Texts of up to ``max_text`` code points come first, in the order of the
    hash of their ids, then longer ones, the shortest first: a long text
    neither ends nor empties a class.  An id with several labels is toxic if
    one of them says so; of several texts the shortest counts.
    """
    own = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
           .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label")))
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    sizes = scratch_table(texts.select("id", F.length("text").alias("length")).join(own, "id")
                          .groupBy("id", "label").agg(F.min("length").alias("length")))
    by = [F.greatest("length", F.lit(max_text)), F.xxhash64("id"), "id"]
    sample = (sizes.where("label = 1").orderBy(*by).limit(max_toxic)
              .union(sizes.where("label = 0").orderBy(*by).limit(max_clean)))
    before = Window.partitionBy("label").orderBy(*by)        # over the sample only
    sample = (sample.withColumns({"nth": F.row_number().over(before),
                                  "chars": F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, 0))})
              .where((F.col("chars") <= max_chars) | (F.col("nth") == 1)).select("id", "label"))
    rows = (texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min(F.struct(F.length("text").alias("length"), "text")).alias("t"))
            .orderBy(F.xxhash64("id"), "id").select("label", "t.text").toPandas())
    return train(rows["text"].tolist(), rows["label"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of each whole text as a further column.

    Null and empty texts are scored as a window without words; an empty table
    gives an empty result; a column that is already named ``out_col`` is replaced.
    """
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(model)            # fixed size
    rest = [c for c in docs.columns if c.lower() != out_col.lower()]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            s = pa.array(m.score(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, out_col])

    rows = docs.select(*rest)
    return map_batches(rows, run, StructType([*rows.schema.fields, StructField(out_col, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` (score >= 0.5).

    Without labelled rows of both classes every text gets the same score.
    Repeated rows keep a row each; null ids are never held out.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = score(docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), model)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
