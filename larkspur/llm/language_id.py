"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

* Text: naive Bayes over hashed byte trigrams, counted over all texts with a declared language.
* Declared language and address suffix: P(value | language), counted over all rows by the language their text shows, and
  smoothed by the share that the value has of all rows.  A host without a dot has no suffix to speak for it.
* Host: P(language | host), smoothed hierarchically: host by its parent domain, that by all rows.
* None of them: a background in which a text's letters come singly, as often as in all texts, or its trigrams at random.
  A text that it explains better than any language is not identified.

All tables come from grouped aggregation over all rows.  The text model covers every declared value; it has an entry for
each bin that occurs with it (for all bins of up to DENSE values); host, suffix and declaration tables are written down
and joined, so that Spark knows their size and broadcasts only small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Workspace, keep, mix64, slices, small_batches, text_bytes

BINS = 1 << 14
#: Trigrams of one text overlap: they count as this share of as many independent ones.
TEMPER = 0.2
#: Prior of the background, and the name of what it explains best.
BACKGROUND, UNKNOWN = 0.01, "und"
#: Pseudo-counts of a level's parent.
PRIOR_ROWS = 20.0
#: Up to so many declared values have dense tables; of more, only the trigrams that occur are held.  All are modelled.
DENSE = 64
#: Pairs of a trigram and a language that are handled at a time.
PAIRS = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of byte trigrams that hold a letter, the number of the text each is from, and where it begins."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, letter = folded(data)
    low = low.astype(np.uint64)
    code = low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(code)]
    good = np.flatnonzero((np.arange(len(code)) + 3 <= offs[doc + 1]) & (letter[:-2] | letter[1:-1] | letter[2:]))
    return (mix64(code[good]) % np.uint64(BINS)).astype(np.int64), doc[good], good


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and all but letters as blanks, and which are letters."""
    low = _LOWER[data]
    letter = _LETTER[low]
    return np.where(letter, low, np.uint8(32)), letter


def _count(languages: list[str]):
    """Counts of bins by language, and (as language -1) of folded bytes in all texts."""

    def entries(total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total // BINS, pa.int32()), pa.array(total % BINS, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bin", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep(_count, dict)  # no other operator's tables stay in the worker
        at = {x: i for i, x in enumerate(languages)}
        dense = len(languages) <= DENSE
        total = np.zeros(len(languages) * BINS if dense else 0, np.int64)
        letters = np.zeros(256, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                lang = np.array([at.get(x, -1) for x in part.column("_declared").to_pylist()])
                data, offs = text_bytes(part.column("_text"))
                bins, doc, _ = trigrams(data, offs)
                letters += np.bincount(folded(data)[0], minlength=256)
                known = lang[doc] >= 0 if len(doc) else np.zeros(0, bool)
                code = lang[doc[known]] * BINS + bins[known]
                if dense:
                    total += np.bincount(code, minlength=len(total))
                elif len(code):
                    yield entries(*np.unique(code, return_counts=True))
        if dense:
            seen = np.nonzero(total)[0]
            yield entries(seen, total[seen])
        seen = np.nonzero(letters)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), -1), pa.int32()), pa.array(seen, pa.int32()), pa.array(letters[seen], pa.int64())], names=["lang", "bin", "n"])

    return run


class _Model:
    """Log-likelihoods of bins by language: a dense table, or what occurring bins add to the value of all others."""

    def __init__(self, n_lang: int, lang: np.ndarray, bins: np.ndarray, n: np.ndarray):
        self.n_lang = n_lang
        letters = np.full(256, 0.5)
        letters[bins[lang < 0]] += n[lang < 0]
        self.letters = np.log(letters / letters.sum())
        lang, bins, n = lang[lang >= 0], bins[lang >= 0], n[lang >= 0]
        total = np.bincount(lang, n, n_lang) + 0.5 * BINS
        if n_lang <= DENSE:
            counts = np.full((n_lang, BINS), 0.5)
            counts[lang, bins] += n
            self.table = np.log(counts / total[:, None]) if n_lang else counts
            return
        order = np.argsort(bins, kind="stable")
        self.table, self.other = None, np.log(0.5 / total)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(bins, minlength=BINS))))
        self.lang = lang[order].astype(np.int32)
        self.more = np.log((n[order] + 0.5) / 0.5)

    def background(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        """Log-likelihood of the trigrams of each text if nothing but the background made them."""
        if not len(at):
            return np.zeros(rows)
        p = self.letters[folded(data)[0]]
        single = p[at] + p[at + 1] + p[at + 2]
        return np.bincount(doc, np.logaddexp(single, -np.log(BINS)) - np.log(2), rows)

    def score(self, bins: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        """Sums over the bins of each text: rows x languages."""
        if self.table is not None:
            return np.stack([np.bincount(doc, row[bins], rows) for row in self.table], axis=1) if self.n_lang else np.zeros((rows, 0))
        out = np.bincount(doc, minlength=rows)[:, None] * self.other
        flat = out.reshape(-1)
        step = max(PAIRS // self.n_lang, 1)
        for i in range(0, len(bins), step):
            b, d = bins[i : i + step], doc[i : i + step]
            size = self.first[b + 1] - self.first[b]
            ends = np.cumsum(size)
            at = np.repeat(self.first[b] - ends + size, size) + np.arange(ends[-1])
            np.add.at(flat, np.repeat(d, size) * self.n_lang + self.lang[at], self.more[at])
        return out


def _likelihoods(model: _Model):
    """Adds _ll (tempered log-likelihood of each language, then of the background) and _grams to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep(_count, dict)
        for batch in batches:
            for part in slices(batch, "_text"):
                data, offs = text_bytes(part.column("_text"))
                bins, doc, at = trigrams(data, offs)
                n = np.bincount(doc, minlength=part.num_rows)
                ll = np.column_stack([model.score(bins, doc, part.num_rows), model.background(data, at, doc, part.num_rows)]) * TEMPER
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
                yield part.append_column("_ll", flat).append_column("_grams", pa.array(n, pa.int64()))

    return run


def page_evidence(html: Column, url: Column) -> dict[str, Column]:
    """What a web page says: declared (the lang attribute of its html element), host, and text without markup."""
    head = F.regexp_extract(html, r"(?is)<html\b([^>]*)>", 1)
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return {"declared": F.nullif(F.regexp_extract(head, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,8}(?:-[A-Za-z0-9]+)*)", 1), F.lit("")), "host": address_host(url), "text": plain}


def address_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def identify(
    docs: DataFrame,
    *,
    text: Column,
    declared: Column,
    host: Column,
    suffix: Column | None = None,
    workspace: Workspace | None = None,
    confidence: float = 0.5,
) -> DataFrame:
    """docs with language, confidence (posterior) and accepted added (under `_language`, `_confidence`, `_accepted`).

    declared: language that markup or a feed states (null: none); host: as in an address, or any name of the source;
    suffix: last label of the host unless given, none if the host has no dot.  A text without letters, null and empty ones
    included, has language "und" and is not accepted; nor is one that the background explains best, or whose posterior is
    below `confidence`.  Languages that tie are taken in the order of their names.  Repeated rows are handled each by
    itself.  Empty table: empty result.  Texts of any length count whole; of a very long one a task holds some arrays of 8
    bytes for each of its bytes.  docs may have any columns but the three that are added.
    """
    spark = docs.sparkSession
    taken = {"_language", "_confidence", "_accepted"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns that the result adds exist already: {sorted(taken)}")
    small_batches(spark)
    workspace = workspace or Workspace(spark, "language")
    host = F.coalesce(host, F.lit(""))
    own = F.when(F.contains(host, F.lit(".")), F.element_at(F.split(host, r"\."), -1))
    keyed = docs.select(
        F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_row"),
        text.cast("string").alias("_text"),
        F.coalesce(F.lower(F.substring_index(declared, "-", 1)), F.lit("")).alias("_declared"),
        host.alias("_host"),
        F.regexp_replace(host, r"^[^.]*\.(?=[^.]*\.)", "").alias("_parent"),
        F.coalesce(suffix if suffix is not None else own, F.lit("")).alias("_suffix"),
    )
    seen = keyed.filter("_declared <> ''").select("_declared").distinct().collect()
    languages = sorted(r["_declared"] for r in seen)
    grams = keyed.select("_text", "_declared").mapInArrow(_count(languages), "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    held = grams.toArrow()  # what occurs of languages x BINS
    model = _Model(len(languages), *(held.column(c).to_numpy().astype(np.int64) for c in ("lang", "bin", "n")))
    n_lang = len(languages)
    names = F.lit(languages) if languages else F.array().cast("array<string>")
    best = lambda c: F.when(F.size(c) > 0, F.array_position(c, F.array_max(c)).cast("int"))

    scored = keyed.mapInArrow(_likelihoods(model), T.StructType([*keyed.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_grams", T.LongType())]))
    # a language's rows: those whose text it explains best; those of the background count for none
    shown = workspace.store(
        keyed.select("_text", "_declared", "_host", "_parent", "_suffix")
        .mapInArrow(_likelihoods(model), "_text string, _declared string, _host string, _parent string, _suffix string, _ll array<double>, _grams long")
        .filter("_grams > 0")
        .groupBy("_declared", "_host", "_parent", "_suffix", best(F.col("_ll")).alias("l"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("l") <= n_lang)
    )

    def vector(key: str) -> DataFrame:
        """Rows of each language by a key."""
        if n_lang <= DENSE:
            sums = [F.sum(F.when(F.col("l") == i + 1, F.col("n")).otherwise(0)).cast("double") for i in range(n_lang)]
            return shown.groupBy(key).agg(F.array(*sums).alias("v") if sums else F.array().cast("array<double>").alias("v"))
        by = shown.groupBy(key, "l").agg(F.sum("n").cast("double").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("m"))
        return by.select(key, F.transform(F.sequence(F.lit(1), F.lit(n_lang)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))

    share = np.ones(n_lang)
    for r in shown.groupBy("l").agg(F.sum("n").alias("n")).collect():
        if r["l"] is not None:
            share[r["l"] - 1] += r["n"]
    root = F.lit((share / share.sum()).tolist()) if n_lang else F.array().cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda v, over: F.transform(over, lambda p, i: (F.get(v, i) + PRIOR_ROWS * p) / (total(v) + PRIOR_ROWS))
    parents = workspace.store(vector("_parent").select("_parent", smooth(F.col("v"), root).alias("_pp")))
    hosts = shown.select("_host", "_parent").distinct().join(vector("_host"), "_host").join(parents, "_parent")
    hosts = workspace.store(hosts.select("_host", smooth(F.col("v"), F.col("_pp")).alias("_ph")))
    counts, everything = share - 1, max(float(share.sum() - n_lang), 1.0)
    held = F.lit(counts.tolist()) if n_lang else F.array().cast("array<double>")

    def given(key: str, out: str) -> DataFrame:
        """P(value | language), smoothed with PRIOR_ROWS rows that have the value as often as all rows do; last, that share."""
        overall = total(F.col("v")) / everything
        by = F.transform(F.col("v"), lambda x, i: (x + PRIOR_ROWS * overall) / (F.get(held, i) + PRIOR_ROWS))
        return workspace.store(vector(key).select(key, F.concat(by, F.array(overall)).alias(out)))

    said, ends = given("_declared", "_pd"), given("_suffix", "_ps")
    out = scored.join(hosts, "_host", "left").join(said, "_declared", "left").join(ends, "_suffix", "left")
    known = lambda c, i: F.log(F.greatest(F.coalesce(F.get(c, i), F.lit(1.0)), F.lit(1e-12)))
    prior = F.transform(F.coalesce("_ph", root), lambda p: p * (1 - BACKGROUND))
    prior = F.concat(prior, F.array(F.lit(BACKGROUND)))
    silent = lambda key, i, c: F.when(F.col(key) == "", F.lit(0.0)).otherwise(known(c, i))
    log_post = F.transform("_ll", lambda x, i: x + known(F.col("_prior"), i) + silent("_declared", i, F.col("_pd")) + silent("_suffix", i, F.col("_ps")))
    out = out.withColumn("_prior", prior).withColumn("_lp", log_post).withColumn("_top", F.array_max("_lp"))
    post = 1 / F.aggregate("_lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    place = F.array_position("_lp", F.col("_top")).cast("int") - 1
    out = out.withColumns(
        {
            "_language": F.when(F.col("_grams") > 0, F.coalesce(F.get(names, place), F.lit(UNKNOWN))).otherwise(UNKNOWN),
            "_confidence": F.when(F.col("_grams") > 0, F.coalesce(post, F.lit(0.0))).otherwise(0.0),
        }
    ).withColumn("_accepted", (F.col("_language") != UNKNOWN) & (F.col("_confidence") >= confidence))
    return out.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)), "_language", "_confidence", "_accepted")
