"""Operator 7: personal data by patterns and a linear-chain conditional random field.

The patterns give the base spans (their rules are fixed).  The field adds
spans that the patterns miss, such as numbers written with other separators
or addresses spelt out.  It labels tokens by their word shapes and those of
their neighbours; it is trained in numpy on a small labelled table
(``labelled_table``) and decoded by Viterbi over batches of token runs.  Runs
are all stretches around tokens that hold a digit, an at sign or a spelt-out
sign; elsewhere there is nothing to label.  An added span must hold a valid
value of its kind and may not touch a base span.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Recent, map_batches, whole_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

# The base patterns.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _to_255(digits: str) -> bool:
    """Whether digits, however many, are a number up to 255."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _emails(text: str) -> list[Span]:
    """Leftmost matches: the longest local part before each at sign, from the end of the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)                      # no local part reaches across an at sign
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind, then place."""
    out = _emails(text)
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_to_255(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# -- word shapes ------------------------------------------------------------------
_TOKEN = re.compile(r"\S+")
#: What makes a token worth labelling, with the tokens around it.
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\s*(?:at|dot)\s*[\])}>]", re.I)
AROUND = 4                                    # tokens of context on either side of a run
#: Digits and code points that the valid values of a kind have, at most: the longest numbers with up to four
#: separators between their digits, the longest address that mail allows.
LEAST_DIGITS = {"ip": 4, "card": 13, "phone": 9}
MOST_DIGITS = {"ip": 12, "card": 19, "phone": 15}
MOST_CHARS = {"email": 320, **{k: 5 * n for k, n in MOST_DIGITS.items()}}
#: Steps (runs times the longest of them) that are decoded together.
STEPS = 1 << 15
FEATURES = 1 << 12
_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^\x00-\x7f]+|.", re.S)
# Words that often stand beside personal data.
CUES = frozenset(("phone tel telephone call mobile fax cell number card visa mastercard amex credit mail email e-mail address ip host "
                  "server at dot contact write order version page price year date").split())
_SIZES = (1, 2, 3, 4, 5, 8, 13, 20)


def shape(token: str) -> str:
    """Word shape: digits with their number (in classes), letters by case, the rest as it is."""
    out = []
    for m in _RUNS.findall(token):
        c = m[0]
        if c.isdigit() and c.isascii():
            out.append("d" + str(max(s for s in _SIZES if s <= len(m))))
        elif c.isalpha():
            out.append("x" if m.islower() or not m.isascii() else "X")
        else:
            out.append(c)
    return "".join(out)


def features(token: str) -> list[int]:
    """Hashed feature numbers of a token."""
    s, word = shape(token), token.strip("[](){}<>.,;:!?\"'").lower()
    plain = re.sub(r"\d", "", s)
    digits = len(_digits(token))
    names = ["1", "s:" + s, "p:" + plain, f"n:{max(x for x in (0, *_SIZES) if x <= digits)}", "@" if "@" in token else "",
             f"dots:{min(4, token.count('.'))}", f"dash:{min(4, token.count('-'))}", "c:" + token[:1] if not token[:1].isalnum() else "",
             "w:" + word if word in CUES else ""]
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names if n})


class Field:
    """A linear-chain conditional random field; a token's score sums the
    weights of its own features and of those of both neighbours."""

    def __init__(self):
        k = len(LABELS)
        self.w = np.zeros((3, FEATURES, k))               # before, own, after
        self.t = np.zeros((k, k))
        self._known: Recent | None = None

    def __getstate__(self):
        return {"w": self.w, "t": self.t, "_known": None}

    def parts(self, token: str) -> np.ndarray:
        """(3, labels) scores that a token gives to the next, itself and the one before."""
        if self._known is None:
            self._known = Recent(lambda t: self.w[:, features(t)].sum(1), 100_000)
        return self._known[token]

    def scores(self, runs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(runs, steps, labels) scores, padded, and the runs' lengths."""
        size = np.array([len(r) for r in runs])
        p = np.zeros((len(runs), int(size.max()) + 2, 3, len(LABELS)))
        for i, r in enumerate(runs):
            p[i, 1: len(r) + 1] = [self.parts(t) for t in r]
        return p[:, 1:-1, 1] + p[:, :-2, 0] + p[:, 2:, 2], size

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each run (Viterbi over all runs at once, in pieces
        of ``STEPS`` steps: scores are held for one piece, the best labels
        before it are carried on; one byte a step and label is kept)."""
        size = np.array([len(r) for r in runs])
        n, steps, k = len(runs), int(size.max()), len(LABELS)
        piece = max(2, STEPS // n)
        back = np.zeros((steps, n, k), np.int8)
        best = np.zeros((n, k))
        for lo in range(0, steps, piece):
            # one token more on either side, whose scores there are not used
            s = self.scores([r[max(0, lo - 1): lo + piece + 1] or [""] for r in runs])[0][:, lo > 0:]
            for i in range(lo, min(steps, lo + piece)):
                if i == 0:
                    best = s[:, 0]
                    continue
                step = best[:, :, None] + self.t
                back[i] = step.argmax(1)
                if i - lo < s.shape[1]:
                    best = np.where((i < size)[:, None], step.max(1) + s[:, i - lo], best)
        out = np.zeros((n, steps), np.int8)
        at = best.argmax(1)
        rows = np.arange(n)
        for i in range(steps - 1, -1, -1):
            out[:, i] = at
            at = np.where((i > 0) & (i < size), back[i][rows, at], at)
        return [out[i, :m] for i, m in enumerate(size)]

    def fit(self, runs: list[list[str]], labels: list[list[int]], *, rounds: int = 150, rate: float = 0.1, ridge: float = 2e-3) -> "Field":
        """Maximum likelihood with a ridge, by Adam on the exact gradient."""
        size = np.array([len(r) for r in runs])
        n, steps, k = len(runs), int(size.max()), len(LABELS)
        live = np.arange(steps) < size[:, None]
        y = np.zeros((n, steps), np.int64)
        for i, lab in enumerate(labels):
            y[i, : len(lab)] = lab
        run, step, feature = [], [], []
        for i, r in enumerate(runs):
            for j, token in enumerate(r):
                f = features(token)
                run += [i] * len(f)
                step += [j] * len(f)
                feature += f
        run, step, feature = map(np.array, (run, step, feature))
        shift = np.array([1, 0, -1])                      # a token speaks to the next, itself, the one before
        m = [np.zeros_like(self.w), np.zeros_like(self.t)]
        v = [np.zeros_like(self.w), np.zeros_like(self.t)]
        gold = np.eye(k)[y] * live[:, :, None]
        pairs = np.zeros((k, k))
        both = live[:, 1:]
        np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
        for r in range(1, rounds + 1):
            s = np.zeros((n, steps, k))
            inside = []
            for a, d in enumerate(shift):
                ok = (step + d >= 0) & (step + d < size[run])
                inside.append(ok)
                np.add.at(s, (run[ok], step[ok] + d), self.w[a, feature[ok]])
            fwd, bwd = np.zeros((n, steps, k)), np.zeros((n, steps, k))
            fwd[:, 0] = s[:, 0]
            for i in range(1, steps):
                new = np.logaddexp.reduce(fwd[:, i - 1, :, None] + self.t, 1) + s[:, i]
                fwd[:, i] = np.where(live[:, i, None], new, fwd[:, i - 1])
            z = np.logaddexp.reduce(fwd[:, -1], 1)
            for i in range(steps - 2, -1, -1):
                new = np.logaddexp.reduce(self.t + (s[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
                bwd[:, i] = np.where(live[:, i + 1, None], new, 0)
            p = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
            edge = np.exp(fwd[:, :-1, :, None] + self.t + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            d = (p - gold) / n
            gw = ridge * self.w
            for a, move in enumerate(shift):
                ok = inside[a]
                np.add.at(gw[a], feature[ok], d[run[ok], step[ok] + move])
            for x, g, i in ((self.w, gw, 0), (self.t, (edge.sum((0, 1)) - pairs) / n + ridge * self.t, 1)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                x -= rate * (m[i] / (1 - 0.9 ** r)) / (np.sqrt(v[i] / (1 - 0.999 ** r)) + 1e-8)
        return self


# -- the labelled table -----------------------------------------------------------
# Sentences with places for values; the second part says how the value is written.
_SENTENCES = (
    ("please call {phone} before noon", "phone"), ("my number is {phone} .", "phone"), ("tel {phone} or write to us", "phone"),
    ("the desk can be reached on {phone} all day", "phone"), ("{phone} is the phone of the office", "phone"),
    ("write to {email} for details", "email"), ("contact {email} or call", "email"), ("mail {email} with questions", "email"),
    ("the list is kept by {email} since then", "email"), ("{email} sent this", "email"),
    ("paid with card {card} today", "card"), ("visa {card} was charged", "card"), ("the number {card} is on the card", "card"),
    ("{card} expires soon", "card"), ("credit card {card} .", "card"),
    ("the host {ip} did not answer", "ip"), ("server at {ip} is down", "ip"), ("from ip {ip} port open", "ip"), ("ping {ip} again", "ip"),
    ("licensed under version {version} of it", ""), ("see page {small} and {small} there", ""), ("in the year {year} it was built", ""),
    ("the price is {price} only", ""), ("on {date} we met", ""), ("at {time} the bus left", ""), ("order {id} was sent", ""),
    ("token = {hex} in the file", ""), ("section {version} of the law", ""), ("about {small} of {year} cases", ""),
    ("the sum of {price} and {price} is due", ""), ("item {id} costs {price}", ""), ("the words (at) all (dot) marks are plain", ""),
    ("the words ( at ) all [ dot ] marks are plain", ""), ("rows {small} {small} {small} {small} {small} and {small} of {small}", ""),
    ("room {small}-{small} on floor {small}", ""), ("isbn {isbn} is a book", ""), ("the ratio {small}:{small} holds", ""),
)


def _with_luhn(rng: np.random.Generator, n: int) -> str:
    head = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def _value(kind: str, rng: np.random.Generator) -> str:
    def num(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def name() -> str:
        return "".join(rng.choice(list("abcdeilmnorstu"), int(rng.integers(3, 9))))

    pick = int(rng.integers(0, 8))
    if kind == "phone":
        a, b, c = num(3), num(3), num(4)
        return (f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {num(7)}",
                f"00{num(2)} {a} {b} {c}", " ".join(f"+{num(2)}({a}){b}-{c}"), " ".join(f"{a}-{b}{c}"))[pick]
    if kind == "email":
        u, d = f"{name()}.{num(2)}", name()
        return (f"{u}@{d}.com", f"{name()}@{d}{num(1)}.example.org", f"{name()} (at) {d} (dot) com", f"{name()} [at] {d} [dot] org",
                f"{name()}_{name()}@{d}.de", f"{name()} [at] {d}.net", f"{name()} [ at ] {d} [ dot ] com",
                f"{name()} ( at ) {d} ( dot ) {name()} ( dot ) org")[pick]
    if kind == "card":
        d = _with_luhn(rng, 15 if pick == 5 else 16)
        return (d, " ".join(d[i: i + 4] for i in range(0, 16, 4)), "-".join(d[i: i + 4] for i in range(0, 16, 4)),
                ".".join(d[i: i + 4] for i in range(0, 16, 4)), d, f"{d[:4]} {d[4:10]} {d[10:]}", " ".join(d), " ".join(d))[pick]
    if kind == "ip":
        return (".".join(map(str, rng.integers(0, 256, 4))) if pick else "-".join(map(str, rng.integers(100, 256, 4))))
    return {"version": f"{rng.integers(0, 9)}.{rng.integers(0, 9)}", "small": str(rng.integers(1, 300)), "year": str(rng.integers(1800, 2030)),
            "price": f"{rng.integers(1, 999)}.{num(2)}", "date": f"20{num(2)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
            "time": f"{rng.integers(0, 24)}:{num(2)}", "id": num(int(rng.integers(5, 9))), "isbn": f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
            "hex": '"' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"'}[kind]


def labelled_table(copies: int = 12, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of the training sentences: each fixed sentence with ``copies`` drawn values."""
    rng, out = np.random.default_rng(seed), []
    for sentence, _ in _SENTENCES:
        for _ in range(copies):
            tokens, labels = [], []
            for word in sentence.split():
                m = re.fullmatch(r"(.*?)\{(\w+)\}(.*)", word)
                if m and m[2] in KINDS:
                    value = _value(m[2], rng).split()
                    tokens += value
                    labels += [LABELS.index(m[2])] * len(value)
                else:
                    tokens.append(re.sub(r"\{(\w+)\}", lambda x: _value(x[1], rng), word))
                    labels.append(0)
            out.append((tokens, labels))
    return out


def train() -> Field:
    """The field fitted to the labelled table."""
    table = labelled_table()
    return Field().fit([t for t, _ in table], [y for _, y in table])


# -- spans ------------------------------------------------------------------------
_SPELT = re.compile(r"[\w.+-]+\s*[\[({<]\s*at\s*[\])}>]\s*[\w-]+(?:\s*(?:\.|[\[({<]\s*dot\s*[\])}>])\s*[\w-]+)+", re.I)


def _valid(kind: str, text: str) -> bool:
    """Whether text is a valid number of its kind."""
    d = _digits(text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9 .-]+", text) is not None
    if kind == "phone":
        return 9 <= len(d) <= 15 and re.fullmatch(r"\+?[0-9 ().-]+", text) is not None and bool(re.search(r"[ ().-]", text))
    parts = re.split(r"[.-]", text)
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def token_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens (start, end) around all that may be personal data."""
    if not _TRIGGER.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([t[0] for t in tokens])
    hits = np.unique(np.searchsorted(starts, [m.start() for m in _TRIGGER.finditer(text)], "right") - 1)
    cut = np.flatnonzero(np.diff(hits) > 2 * AROUND)
    first, last = hits[np.concatenate([[0], cut + 1])], hits[np.concatenate([cut, [len(hits) - 1]])]
    return [tokens[max(0, a - AROUND): b + AROUND + 1] for a, b in zip(first.tolist(), last.tolist())]


def _taken(base: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that base spans cover, in order."""
    starts, ends = [], []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_BEFORE, _AFTER = "\"',;:!?<", "\"',;:!?.>#$%&*|"


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A stretch without the punctuation around it."""
    while a < b and text[a] in _BEFORE:
        a += 1
    while b > a and text[b - 1] in _AFTER:
        b -= 1
    return a, b


def _valid_parts(kind: str, text: str, tokens: list[tuple[int, int]], taken: tuple[list[int], list[int]]) -> list[Span]:
    """Valid values among tokens of one label: from the left, the longest
    stretch each time (two numbers may stand side by side), clear of the base
    spans.  A value may be written in any number of tokens."""
    out, at = [], 0
    starts, ends = taken

    def clear(a: int, b: int) -> bool:
        i = bisect_right(ends, a)
        return i == len(starts) or b <= starts[i]

    if kind == "email":
        place = {_trimmed(text, a, b)[1]: i for i, (a, b) in enumerate(tokens)}
        while at < len(tokens):
            a = _trimmed(text, *tokens[at])[0]
            m = _SPELT.match(text, a, min(tokens[-1][1], a + MOST_CHARS[kind]))
            at += 1
            if m and m.end() in place and clear(*m.span()):
                out.append((kind, *m.span()))
                at = place[m.end()] + 1
        return out
    digits = [0, *accumulate(sum("0" <= c <= "9" for c in text[a:b]) for a, b in tokens)]
    while at < len(tokens):
        last = at + 1
        while (last < len(tokens) and tokens[last][0] - tokens[at][0] < MOST_CHARS[kind]
               and digits[last + 1] - digits[at] <= MOST_DIGITS[kind]):
            last += 1
        step = 1
        for end in range(last, at, -1):
            if digits[end] - digits[at] < LEAST_DIGITS[kind]:
                break                                     # too few from here on
            a, b = _trimmed(text, tokens[at][0], tokens[end - 1][1])
            if clear(a, b) and _valid(kind, text[a:b]):
                out.append((kind, a, b))
                step = end - at
                break
        at += step
    return out


def _batches(runs: list[tuple[int, list]]) -> Iterator[list[tuple[int, list]]]:
    """Runs, sorted by length, in batches of up to 512 that hold about ``STEPS`` steps when padded."""
    lo = 0
    for hi in range(1, len(runs) + 1):
        if hi == len(runs) or hi - lo == 512 or (hi - lo + 1) * len(runs[hi][1]) > STEPS:
            yield runs[lo:hi]
            lo = hi


def added_spans(field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of the field that are valid and touch no base span."""
    out: list[list[Span]] = [[] for _ in texts]
    runs = [(i, r) for i, t in enumerate(texts) for r in token_runs(t)]
    runs.sort(key=lambda x: len(x[1]))                    # runs of like length share a batch
    taken = {i: _taken(base[i]) for i, _ in runs}
    for batch in _batches(runs):
        for (i, run), labels in zip(batch, field.decode([[texts[i][a:b] for a, b in r] for i, r in batch])):
            at = 0
            while at < len(run):
                end = at + 1
                while end < len(run) and labels[end] == labels[at]:
                    end += 1
                if labels[at]:
                    # an address whose name was not labelled begins a token earlier
                    alone = LABELS[labels[at]] == "email" and at > 0 and not labels[at - 1] and texts[i][run[at][0]] in "[({<"
                    out[i] += _valid_parts(LABELS[labels[at]], texts[i], run[at - alone:end], taken[i])
                at = end
    return out


def digest(spans: list[Span]) -> str:
    """Spans by kind, then place, as text."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``
    (base spans), ``base_sha256``, ``spans`` (base and added), ``n_added``.

    Null and empty texts have no spans; repeated rows keep a row each; an
    empty table gives an empty result; further columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    held = docs.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.pii import KINDS, added_spans, base_spans, digest

        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(held.value, texts, base)
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(digest(x).encode()).hexdigest() for x in base], pa.string())
            spans = pa.array([digest(x + y) for x, y in zip(base, more)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, spans, pa.array([len(x) for x in more], pa.int64())],
                                             ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = map_batches(rows, run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (spans that overlap count as one) replaced by its kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind in brackets;
    ``length_col`` (if it is a column) gets the new number of code points.
    Null texts stay null; all rows and columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(field or train())
    schema = StructType([StructField(f.name, StringType()) if f.name == text_col else
                         StructField(f.name, LongType()) if f.name == length_col else f for f in docs.schema.fields])
    at, n = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.pii import added_spans, base_spans, masked

        for b in batches:
            null = [t is None for t in b.column(at).to_pylist()]
            texts = [t or "" for t in b.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            new = [masked(t, x + y) for t, x, y in zip(texts, base, added_spans(held.value, texts, base))]
            columns = list(b.columns)
            columns[at] = pa.array([None if z else t for t, z in zip(new, null)], pa.string())
            if n is not None:
                columns[n] = pa.array([None if z else len(t) for t, z in zip(new, null)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_batches(docs, run, schema)
