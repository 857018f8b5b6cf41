"""Language identification by Bayesian evidence fusion.

Log evidence is added up for every language and for "no language":

* **text** – hashed byte trigrams of the whole text under a naive Bayes model
  fitted on about ``TRAIN`` labelled rows a language (those with the smallest
  id hashes, so the sample is bounded and the same on every run) for every
  label that occurs ("en-US" and "EN" are "en"), tempered because trigrams
  overlap.  "No language" is a flat model of ``FLAT`` nats a
  trigram, which real text beats clearly and noise does not;
* **declared language** (markup attribute or metadata) – how often each code
  is declared for texts of each language, from a grouped count;
* **address** – a prior for the host, smoothed towards its suffix, which is
  smoothed towards the whole table.  Counts are sums of text posteriors in
  whole thousandths (exact, so reruns agree) in one grouped aggregation; a row's
  own share is taken out of its host's counts before it is used.

A row is kept unless "no language" wins or no language reaches ``MIN_POSTERIOR``.

Rows: a null or empty text has no language: null, posterior 0, not kept; one
too short for a trigram is judged by the other evidence.  Null declared codes,
suffixes and hosts are groups of their own.  Repeated rows are judged alike and null ids allowed.
Codes outside the model's languages count as "other".  There is no bound on the
number of languages: the model grows with the trigrams seen of each, and a row
carries one number per language.  Without labelled rows
nothing can be fitted: every row is kept with a null language.  An empty table
gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common, worker

TRAIN = 1500
CELLS = 1 << 16
DENSE = 64  # up to so many languages the model is a table
TEMPER = 0.25
FLAT = -12.0
SMOOTH_SUFFIX, SMOOTH_HOST = 200.0, 50.0
MIN_POSTERIOR = 0.5
GAP = 60.0  # evidence of one text is limited to this many nats between languages


def trigram_cells(raw: np.ndarray) -> np.ndarray:
    """Hashed trigrams of lower-cased bytes."""
    x = raw.astype(np.uint32)
    x[(raw >= 65) & (raw <= 90)] += 32
    return (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _bytes(b: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for x in b.column(column):
        yield np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8)


class TextModel:
    """log p(trigram | language) for the languages, in code-point order, from
    counts ``n`` of (number of the language, cell), one per pair that occurs.

    Up to ``DENSE`` languages it is a table; beyond, only the pairs that occur
    are held, by cell, as what each has over an unseen cell."""

    STEP = 1024  # cells added up at a time

    def __init__(self, languages: list[str], lang: np.ndarray, cell: np.ndarray, n: np.ndarray):
        self.languages, self.table = languages, None
        total = np.bincount(lang, n, len(languages)) + 0.05 * CELLS
        unseen, seen = np.log(0.05 / total), np.log((n + 0.05) / total[lang])
        if len(languages) <= DENSE:
            p = np.repeat(unseen[:, None], CELLS, 1)
            p[lang, cell] = seen
            self.table = np.ascontiguousarray(np.concatenate([p, np.full((1, CELLS), FLAT)]).T.astype(np.float32))
            return
        order = np.argsort(cell, kind="stable")
        self.unseen, self.start = unseen, np.searchsorted(cell[order], np.arange(CELLS + 1))
        self.lang, self.over = lang[order].astype(np.int32), (seen - unseen[lang])[order].astype(np.float32)

    def _sums(self, found: np.ndarray) -> np.ndarray:
        """Log likelihoods of the cells of a text, "no language" last."""
        if self.table is not None:
            return self.table[found].sum(0, dtype=np.float64)
        out = self.unseen * len(found)
        cells, times = np.unique(found, return_counts=True)
        for i in range(0, len(cells), self.STEP):
            c, t = cells[i : i + self.STEP].astype(np.int64), times[i : i + self.STEP]
            lens = self.start[c + 1] - self.start[c]
            at = np.repeat(self.start[c] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            out = out + np.bincount(self.lang[at], self.over[at] * np.repeat(t, lens), len(out))
        return np.append(out, FLAT * len(found))

    def evidence(self, raw: np.ndarray) -> list[float] | None:
        """Tempered log likelihoods, best at 0; all 0 for a text too short for
        a trigram, None for no text."""
        if len(raw) < 3:
            return [0.0] * (len(self.languages) + 1) if len(raw) else None
        ll = self._sums(trigram_cells(raw)) * TEMPER
        return np.maximum(ll - ll.max(), -GAP).tolist()


def language_code(c: Column) -> Column:
    """The language of a code: "en" of "en-US", "EN" and " en_GB"."""
    return F.lower(F.trim(F.substring_index(F.substring_index(F.trim(c), "-", 1), "_", 1)))


def fit(labelled: DataFrame, id_col="doc_id", text_col="text", label_col="lang", train: int = TRAIN) -> TextModel | None:
    """The model of a bounded sample of each language in ``labelled``."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), language_code(F.col(label_col)).alias("label"))
    rows = rows.where("label <> '' AND length(text) > 2")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row per language
    if not sizes:
        return None
    languages = sorted(sizes)
    shares = labelled.sparkSession.createDataFrame([(x, i, min(1.0, train / sizes[x])) for i, x in enumerate(languages)], "label string, lang int, share double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(common.bounded(shares, 64, len(languages)), "label").where(F.coalesce(draw, F.lit(0.0)) < F.col("share")).select("lang", "text")

    def tables(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["lang", "cell", "n"])
        sums.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), _bytes(b, 1), strict=True):
                if lang not in sums and len(sums) == DENSE:
                    yield from tables(sums)
                got = np.bincount(trigram_cells(raw), minlength=CELLS) if len(raw) > 2 else np.zeros(CELLS, np.int64)
                sums[lang] = sums.get(lang, 0) + got
        yield from tables(sums)

    cells = worker.map_batches(sample, count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = cells.toArrow()  # the cells that occur, at most languages x CELLS rows
    return TextModel(languages, *(table[c].to_numpy() for c in ("lang", "cell", "n")))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def with_softmax(df: DataFrame, name: str, x: Column) -> DataFrame:
    """Column ``name``: the softmax of an array.  Each step is a column of its
    own, so that nothing is computed again for every element."""
    df = df.withColumn("_x", x).withColumn("_most", F.array_max("_x"))
    df = df.withColumn("_w", F.transform("_x", lambda v: F.exp(v - F.col("_most")))).withColumn("_sum", _total(F.col("_w")))
    return df.withColumn(name, F.transform("_w", lambda v: v / F.col("_sum"))).drop("_x", "_most", "_w", "_sum")


def _sum(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def _each(name: str, k: int) -> Column:
    return F.array(*[F.sum(F.element_at(name, i + 1)) for i in range(k)])


def identify(rows: DataFrame, model: TextModel | None, keys: list[str], text_col="text", declared_col="declared", suffix_col="suffix", host_col="host") -> DataFrame:
    """``keys`` plus language, posterior, kept, one row per row."""
    kept = [F.col(c) for c in keys]
    if model is None:
        return rows.select(*kept, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("kept"))
    blob = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # languages x CELLS floats at most
    names, k = model.languages, len(model.languages)
    known = language_code(F.col(declared_col))
    code = F.when(F.col(declared_col).isNull() | (known == ""), F.lit("")).when(known.isin(names), known).otherwise(F.lit("other"))
    light = rows.select(*kept, code.alias("_code"), F.col(suffix_col).alias("_suffix"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    schema = light.drop("_text").schema.add("_e", T.ArrayType(T.DoubleType()))
    at = len(light.columns) - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(blob.value)
        for b in batches:
            e = pa.array([m.evidence(raw) for raw in _bytes(b, at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], e], schema.names)

    # soft: text posterior of the languages alone, in thousandths
    scored = worker.map_batches(light, score, schema)
    langs = F.slice("_e", 1, k)
    soft = F.transform("_q", lambda p: F.round(p * 1000).cast("long"))
    empty = F.array(*[F.lit(0).cast("long")] * k)
    scored = with_softmax(scored, "_q", langs).withColumn("_n", F.coalesce(F.when(F.element_at("_e", k + 1) < 0, soft), empty))
    scored = common.stash(scored.drop("_q"), "language-evidence")

    hosts = scored.groupBy(F.col("_suffix").alias("s"), F.col("_host").alias("h")).agg(_each("_n", k).alias("hn"))
    hosts = common.stash(hosts, "language-hosts")
    whole = [float(x or 0) / 1000 for x in hosts.agg(_each("hn", k).alias("n")).first()["n"] or [0] * k]
    overall = [(x + 1.0) / (sum(whole) + k) for x in whole]
    suffixes = hosts.groupBy(F.col("s").alias("s2")).agg(_each("hn", k).alias("sn"))
    address = hosts.join(common.bounded(suffixes, 160 + 10 * k), F.col("s").eqNullSafe(F.col("s2"))).select("s", "h", "hn", "sn")
    said = scored.groupBy("_code").agg(_each("_n", k).alias("cn")).collect()  # languages + 2 rows
    codes = {r["_code"]: [x / 1000 for x in r["cn"]] for r in said}
    per_code = {c: [float(np.log((n[i] + 1.0) / (whole[i] + k + 2.0))) for i in range(k)] for c, n in codes.items()}
    said = rows.sparkSession.createDataFrame(list(per_code.items()), "_code string, _said array<double>")

    out = scored.join(common.bounded(said, 48 + 8 * k, len(per_code)), "_code")
    out = out.join(common.bounded(address, 320 + 20 * k), F.col("_suffix").eqNullSafe(F.col("s")) & F.col("_host").eqNullSafe(F.col("h")), "left")

    def smoothed(df: DataFrame, name: str, counts: str, base: Column, weight: float) -> DataFrame:
        """Column ``name``: counts without the row's own share, towards base."""
        df = df.withColumn("_c", F.zip_with(counts, "_n", lambda a, b: (a - b) / 1000.0)).withColumn("_base", base)
        df = df.withColumn("_sum", _total(F.col("_c")) + weight)
        return df.withColumn(name, F.zip_with("_c", "_base", lambda x, p: (x + weight * p) / F.col("_sum"))).drop("_c", "_base", "_sum")

    out = smoothed(out, "_ps", "sn", F.array(*map(F.lit, overall)), SMOOTH_SUFFIX)
    out = smoothed(out, "_ph", "hn", F.col("_ps"), SMOOTH_HOST)
    out = out.withColumn("_prior", F.transform("_ph", lambda p: F.log(p)))
    flat = F.array(F.element_at("_e", k + 1) + float(np.log(1.0 / (k + 2))) + float(np.log(1.0 / (k + 1))))
    out = with_softmax(out, "_p", F.concat(_sum(langs, F.col("_said"), F.col("_prior")), flat))
    out = out.withColumn("_best", F.array_max(F.slice("_p", 1, k)))
    best = F.col("_best")
    language = F.element_at(F.array(*map(F.lit, names)), F.array_position(F.slice("_p", 1, k), best).cast("int"))
    sure = F.coalesce((best >= MIN_POSTERIOR) & (F.element_at("_p", k + 1) < best), F.lit(False))
    return out.select(*kept, F.when(sure, language).alias("language"), F.coalesce(F.round(best, 6), F.lit(0.0)).alias("posterior"), sure.alias("kept"))


def from_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, declared, suffix, host) of documents: the declared
    language is their metadata, the host their source."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"))


def page_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def from_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, host) of web pages."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    p = pages.select("page_id", page_text(F.col("html")).alias("text"), declared.alias("declared"), host.alias("host"))
    return p.withColumn("suffix", F.substring_index("host", ".", -1))
