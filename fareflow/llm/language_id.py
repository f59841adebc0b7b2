"""Operator 3: language identification by Bayesian evidence fusion.

The posterior of each language joins four kinds of evidence:

* the text: log-likelihoods of its letter trigrams under a model per language,
  fitted on a bounded, documented sample of rows with a declared language
  (``PER_LANGUAGE`` different texts each, fewer each if there are so many
  languages that they'd be over ``TEXTS``; every language has one) and mixed with a background model of single
  letters; that background and any letters at all, half and half, stand for
  "no known language" (``und``);
* the language its markup or metadata declares, trusted as far as ``TRUST``;
* the suffix of its address (country domain, or a language in the path);
* its host: the share of declared languages among all rows of the host,
  smoothed towards its parent domain and that towards the whole table.  The
  counts are grouped aggregates over all rows; the table has one row per host.

A long text does not drown the rest: its evidence counts as that of at most
``MOST_TRIGRAMS`` trigrams.  Texts whose best language is ``und`` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import map_batches, scratch_table, text_runs, whole_text

PER_LANGUAGE, TEXTS = 250, 6000               # bounds of the training sample: texts a language, texts of all
BLOCK = 24                                    # languages whose cells are looked up at a time
MOST_TRIGRAMS, TRUST, SUFFIX_TRUST = 60, 0.9, 0.7
HOST_WEIGHT, UNKNOWN = 20.0, 0.01             # rows that a parent counts for; prior of no known language
BITS, BACKGROUND = 15, 0.3                    # trigram cells; share of the background in each language's model
# Languages of country domains and of language marks in paths.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "uk": "en",
                   "us": "en", "au": "en", "nz": "en", "ie": "en", "en": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}

_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, single letters, bounds): trigram cells of each text's letters in
    lower case, where other characters are one blank; -1 where a trigram would
    reach past its text."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1]                               # the first of other characters stands for all
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    keep[starts[starts < len(raw)]] = True
    at = np.flatnonzero(keep)
    letters = np.where(letter[at], raw[at], 32).astype(np.uint32)
    bounds = np.concatenate([[0], np.searchsorted(at, ends)])
    cells = np.full(len(letters), -1, np.int64)
    if len(letters) > 2:
        code = (letters[:-2] << 16) | (letters[1:-1] << 8) | letters[2:]
        cells[:-2] = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    for back in (1, 2):
        last = bounds[1:] - back
        cells[last[last >= bounds[:-1]]] = -1
    return cells, letters.astype(np.int64), bounds


@dataclass
class LanguageModel:
    """Languages, probabilities of trigram cells under each (those of its texts, and of any other), and log-probabilities of single letters."""

    languages: list[str]
    cells: list[np.ndarray]                   # cells found in the texts of each language
    chances: list[np.ndarray]                 # float32, of these cells
    rest: np.ndarray                          # float32, of any other cell, by language
    letters: np.ndarray
    held: np.ndarray | None = None            # the table of models of one block

    def table(self, lo: int, hi: int) -> np.ndarray:
        """(cells + 1, languages) float32 of the languages ``lo`` to ``hi``; the last row is for no trigram."""
        if self.held is not None:
            return self.held
        out = np.repeat(self.rest[None, lo:hi], (1 << BITS) + 1, 0)
        out[-1] = 0
        for i in range(lo, hi):
            out[self.cells[i], i - lo] = self.chances[i]
        if len(self.languages) <= BLOCK:
            self.held = out
        return out

    def evidence(self, texts: list[str]) -> np.ndarray:
        """(texts, languages + 1) log-likelihoods, as of ``MOST_TRIGRAMS`` trigrams at most."""
        k = len(self.languages)
        out = np.zeros((len(texts), k + 1))
        for lo, hi in text_runs(texts):
            cells, letters, bounds = trigrams(texts[lo:hi])
            real = cells >= 0
            single = self.letters[letters]
            single[:-2] += single[1:-1] + single[2:]      # a background trigram is three independent letters
            plain = np.exp(single)[:, None]
            n = np.maximum(1, np.add.reduceat(real, bounds[:-1], dtype=np.int64))
            for first in range(0, k + 1, BLOCK):
                last = min(first + BLOCK, k)
                mixed = (1 - BACKGROUND) * self.table(first, last)[cells] + np.float32(BACKGROUND) * plain if first < k else plain[:, :0]
                if first + BLOCK > k:                     # und: half of it any letters
                    mixed = np.concatenate([mixed, 0.5 * plain + np.float32(0.5 / (1 << BITS))], 1)
                log = np.log(mixed)
                log[~real] = 0
                total = np.add.reduceat(log, bounds[:-1], 0, dtype=np.float64)
                out[lo:hi, first: first + log.shape[1]] = total * (np.minimum(n, MOST_TRIGRAMS) / n)[:, None]
        return out


def cell_counts(texts: list[str]) -> np.ndarray:
    """Counts of the trigram cells of texts, then of their single letters."""
    out = np.zeros((1 << BITS) + 256, np.int64)
    for lo, hi in text_runs(texts):
        cells, single, _ = trigrams(texts[lo:hi])
        out[: 1 << BITS] += np.bincount(cells[cells >= 0], minlength=1 << BITS)
        out[1 << BITS:] += np.bincount(single, minlength=256)
    return out


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """Trigram models of the languages, from (places, counts) of their cells
    and letters as ``cell_counts`` numbers them, and the letter background of all."""
    names = sorted(counts)
    found, chances, rest = [], [], np.zeros(len(names), np.float32)
    letters = np.full(256, 0.5)
    for i, name in enumerate(names):
        place, n = (np.asarray(x, np.int64) for x in counts[name])
        cell = place < 1 << BITS
        np.add.at(letters, place[~cell] - (1 << BITS), n[~cell])
        total = n[cell].sum() + 1e-3 * (1 << BITS)
        order = np.argsort(place[cell])
        found.append(place[cell][order].astype(np.uint16))
        chances.append(((n[cell][order] + 1e-3) / total).astype(np.float32))
        rest[i] = 1e-3 / total
    return LanguageModel(names, found, chances, rest, np.log(letters / letters.sum()).astype(np.float32))


def train(texts: list[str], languages: list[str]) -> LanguageModel:
    """The model of labelled texts at hand."""
    counts = {}
    for name in sorted(set(languages)):
        n = cell_counts([t for t, x in zip(texts, languages) if x == name])
        counts[name] = (np.flatnonzero(n), n[n > 0])
    return model_of(counts)


def sample(rows: DataFrame, *, text_col: str, declared_col: str, per_language: int = PER_LANGUAGE, most: int = TEXTS) -> DataFrame:
    """(language, text): at most ``per_language`` different texts of every
    declared language, those of the lowest hashes; fewer of each if there
    are so many languages that they'd be over ``most``, but one at least."""
    text, declared = whole_text(text_col), language_code(F.col(declared_col))
    low = F.col("h").bitwiseAND((1 << 62) - 1)
    different = scratch_table(rows.select(declared.alias("language"), F.xxhash64(text).alias("h")).where("language is not null").distinct())
    sizes = different.groupBy("language").count()
    each = max(1, min(per_language, most // max(1, sizes.count())))
    # hashes below a share that leaves four times the sample (of few texts far more); only those are ranked
    share = float(max(4 * each, 100)) / F.col("count")
    picked = (different.join(F.broadcast(sizes), "language").where(low / float(1 << 62) < share)
              .withColumn("nth", F.row_number().over(Window.partitionBy("language").orderBy(low, "h"))).where(F.col("nth") <= each))
    return (rows.select(declared.alias("language"), F.xxhash64(text).alias("h"), text.alias("text"))
            .join(F.broadcast(picked.select("language", "h")), ["language", "h"]).dropDuplicates(["language", "h"]).drop("h"))


def fit(rows: DataFrame, *, text_col: str, declared_col: str, per_language: int = PER_LANGUAGE, most: int = TEXTS) -> LanguageModel:
    """Fits the model to the ``sample`` of the rows.  Its texts, of any length,
    are counted in tasks, a batch at a time; the texts of a language, at most
    ``per_language``, meet in one task, so there are as many rows of counts
    as languages, however the rows were dealt.  The driver gets these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.language_id import cell_counts

        def row(name, n):
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([at], pa.list_(pa.int32())), pa.array([n[at]], pa.list_(pa.int64()))],
                                              ["language", "place", "n"])

        held, so_far = None, None                         # one language's counts: they come in order of the language
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in sorted(set(names)):
                n = cell_counts([t for t, x in zip(texts, names) if x == name])
                if held is not None and name != held:
                    yield row(held, so_far)
                    so_far = None
                held, so_far = name, n if so_far is None else so_far + n
        if held is not None:
            yield row(held, so_far)

    texts = sample(rows, text_col=text_col, declared_col=declared_col, per_language=per_language, most=most)
    dealt = texts.repartition("language").sortWithinPartitions("language")
    each = map_batches(dealt, run, "language string, place array<int>, n array<long>").toPandas()
    return model_of({r.language: (r.place, r.n) for r in each.itertuples()})


def language_code(declared: Column) -> Column:
    """Primary part of a declared language tag, in lower case; null if there is none."""
    code = F.lower(F.regexp_extract(declared.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(code != "", code)


def host_priors(rows: DataFrame, languages: list[str], *, host: str, parent: str, declared: str,
                weight: float = HOST_WEIGHT) -> tuple[DataFrame, np.ndarray]:
    """A table (``prior_host``, ``prior``) of smoothed shares of ``languages``
    per host - host towards parent, parent towards all rows - and the shares of all rows."""
    names = F.split(F.lit("\x1f".join(languages)), "\x1f")
    known = F.when(F.array_contains(names, F.col(declared)), F.col(declared))   # one row per host and language, however many there are
    counts = scratch_table(rows.groupBy(host, parent, declared).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("known", known))
    sums = {r.known: r.n for r in counts.where("known is not null").groupBy("known").agg(F.sum("n").alias("n")).collect()}
    total = np.array([sums.get(name, 0.0) for name in languages]) + 1.0
    share = total / total.sum()
    shares = F.split(F.lit("\x1f".join(repr(float(x)) for x in share)), "\x1f").cast("array<double>")

    def by(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        of = F.col("known").isNotNull()
        return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(of, F.struct("known", "n")))).alias(name),
                                       F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0.0)).alias(f"{name}_all"))

    named = counts.where(F.col(host).isNotNull())
    each = by(named, [host, parent], "own")
    above = by(named.groupBy(parent, "known").agg(F.sum("n").alias("n")), [parent], "up")

    def smoothed(name, part):
        own, up = (F.coalesce(F.try_element_at(F.col(m), name), F.lit(0.0)) for m in ("own", "up"))
        return (own + weight * (up + weight * part) / (F.col("up_all") + weight)) / (F.col("own_all") + weight)

    joined = each.join(above, each[parent].eqNullSafe(above[parent])).drop(above[parent])
    return scratch_table(joined.select(F.col(host).alias("prior_host"), F.zip_with(names, shares, smoothed).alias("prior"))), share


def fuse(model: LanguageModel, likelihood: np.ndarray, declared: list, suffix: list, prior: np.ndarray) -> np.ndarray:
    """Posterior (rows, languages + 1) of the languages and ``und``."""
    k = len(model.languages)
    place = {name: i for i, name in enumerate(model.languages)}
    log = likelihood + np.log(np.concatenate([prior * (1 - UNKNOWN), np.full((len(prior), 1), UNKNOWN)], 1))
    for values, trust in ((declared, TRUST), (suffix, SUFFIX_TRUST)):
        other = np.log((1 - trust) / max(1, k))
        for i, v in enumerate(values):
            if v in place:                                # und says nothing about it: as likely as by chance
                log[i, :k] += other
                log[i, place[v]] += np.log(trust) - other
                log[i, k] += np.log(1 / (k + 1))
    log -= log.max(1, keepdims=True)
    odds = np.exp(log)
    return odds / odds.sum(1, keepdims=True)


def identify(rows: DataFrame, *, text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source",
             suffix_col: str | None = None, parent_col: str | None = None, model: LanguageModel | None = None,
             prefix: str = "") -> DataFrame:
    """``rows`` with ``<prefix>language``, ``<prefix>confidence`` and ``<prefix>rejected``.

    ``host_col`` names the host, ``parent_col`` its parent domain (by default
    what follows the first dot of the host), ``suffix_col`` a language that
    the address suggests.  Null or unknown declarations, hosts and suffixes
    are no evidence.  A text without letters goes by the other evidence;
    without any it is as likely each language as the whole table says.
    Without a single declared language everything is ``und`` and rejected.
    Repeated rows keep a row each; columns named like the new ones are replaced.
    """
    own = {c.lower() for c in (f"{prefix}language", f"{prefix}confidence", f"{prefix}rejected")}
    base = rows.select(*[rows[c] for c in rows.columns if c.lower() not in own])
    columns = base.columns
    model = model or fit(rows, text_col=text_col, declared_col=declared_col)
    host = rows[host_col].cast("string") if host_col else F.lit(None).cast("string")
    host = F.when(F.trim(host) != "", F.lower(F.trim(host)))
    parent = rows[parent_col].cast("string") if parent_col else F.regexp_extract(host, r"\.(.+)$", 1)
    suffix = rows[suffix_col].cast("string") if suffix_col else F.lit(None).cast("string")
    # the caller's columns travel as one, so none of them can clash with the evidence
    marked = rows.select(F.struct(*[rows[c] for c in columns]).alias("row"), whole_text(text_col).alias("text"),
                         language_code(rows[declared_col]).alias("declared"), suffix.alias("suffix"), host.alias("host"), parent.alias("parent"))
    k = len(model.languages)
    if k:
        priors, share = host_priors(marked.select("host", "parent", "declared"), model.languages, host="host", parent="parent", declared="declared")
        marked = marked.join(priors.withColumnRenamed("prior_host", "host"), "host", "left")
    else:
        share, marked = np.empty(0), marked.withColumn("prior", F.array().cast("array<double>"))
    held = rows.sparkSession.sparkContext.broadcast((model, share))   # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.language_id import fuse

        m, whole = held.value
        names = np.array([*m.languages, "und"])
        for b in batches:
            texts = b.column(1).to_pylist()
            prior = np.array([whole if p is None else p for p in b.column(4).to_pylist()]).reshape(len(texts), len(m.languages))
            post = fuse(m, m.evidence(texts), b.column(2).to_pylist(), b.column(3).to_pylist(), prior)
            best = post.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*b.column(0).flatten(), pa.array(names[best].tolist(), pa.string()),
                 pa.array(post[np.arange(len(best)), best], pa.float64()), pa.array(best == len(m.languages))],
                [*columns, f"{prefix}language", f"{prefix}confidence", f"{prefix}rejected"])

    schema = StructType([*base.schema.fields, StructField(f"{prefix}language", StringType()),
                         StructField(f"{prefix}confidence", DoubleType()), StructField(f"{prefix}rejected", BooleanType())])
    return map_batches(marked.select("row", "text", "declared", "suffix", "prior"), run, schema)


def page_evidence(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with columns ``host``, ``domain`` (its last two labels),
    ``markup_lang`` (of the html element) and ``suffix_lang`` (a language mark
    that begins the path, else that of a country domain)."""
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    domain = F.regexp_extract(host, r"([^.]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    return pages.withColumns({"host": F.when(host != "", host), "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
                              "markup_lang": F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1),
                              "suffix_lang": F.coalesce(F.try_element_at(known, path), F.try_element_at(known, domain))})
