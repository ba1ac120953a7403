"""Quality rules: counting rules on words, symbols and repetition, and language-specific perplexity bands.

The perplexity of a text is that of its words under the character model of its language (``char_kn``), which counts every
document. A language's band is the quartiles of the mean log10 word probability over its distinct texts of at least
``min_words`` words, widened by ``width`` times their distance, ``MIN_REACH`` at least; a text below is unlike the language,
one above repeats the commonest words. Copies of a text count once, so many of them do not narrow the band around it. Nothing but the bands and the model's files is shared between documents, so texts are not shuffled.

Defined cases: null and empty texts have no words, all counts 0, no perplexity, and fail the base rules; a null
language is a language of its own; repeated rows are judged alike; one document of a language makes a band that holds
it; an empty table gives an empty result; columns named like a new one are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.char_kn import Model, SortedArrays, language_seed, mean_log10, train, write_sorted
from canopy.llm.common import SPACES, add_columns, as_bytes, map_rows, shared_folder
from canopy.llm.line_dedup import row_id

SYMBOLS = "#*$%&|<>"
ORDER = 4
#: Texts that a worker scores at a time, each distinct word once.
ROWS = 2000
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Quartile distances that a band reaches beyond the quartiles.
WIDTH = 6.0
#: Least reach of a band beyond the quartiles, in log10 of a word's probability: ordinary prose has quartiles some 0.12 to
#: 0.18 apart, so it binds only where near copies of one text make up most of a language.
MIN_REACH = 0.75
#: Column with the hash of the text, which tells copies from other texts.
TEXT_ID = "__text_id"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            repeated_lines += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        often, last = Counter(grams), -1
        for i, gram in enumerate(grams):
            if often[gram] > 1:
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), repeated_lines, repeated


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = ", ".join(f"{n} bigint" for n in BASE) + ", base_failed boolean, mean_log10 double"
VERDICT = "perplexity double, kept boolean"


def score(docs: DataFrame, model: Model, limits: SortedArrays | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``mean_log10`` (of a word's probability); with the bands given,
    also with the columns of ``judge``."""
    def run(c):
        texts, langs = as_bytes(c["text"]), c["lang"].to_pylist()
        counts = [base_counts(t.decode()) for t in texts]
        out = {n: [r[k] for r in counts] for k, n in enumerate(BASE)}
        out["base_failed"] = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEATED_PERCENT * r[0] for r in counts]
        out["mean_log10"] = mean_log10(model, langs, texts)
        return out if limits is None else out | _verdicts(langs, out["mean_log10"], out["base_failed"], limits)

    return add_columns(docs, ["lang", "text"], run, SCORES if limits is None else f"{SCORES}, {VERDICT}", rows=ROWS)


def bands(scored: DataFrame, folder: str, width: float = WIDTH) -> SortedArrays:
    """Lower and upper mean log10 probability of each language, as a sorted array by the language's hash."""
    quartiles = F.percentile_approx("mean_log10", [0.25, 0.75], 10_000)
    texts = (scored.where(F.col("n_words") >= MIN_WORDS).groupBy(F.coalesce("lang", F.lit("")).alias("lang"), TEXT_ID)
             .agg(F.min("mean_log10").alias("mean_log10")))
    by_lang = (texts.groupBy("lang").agg(quartiles.alias("q")).select("lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")))
    reach = F.greatest(width * (F.col("q3") - F.col("q1")), F.lit(MIN_REACH)) + 1e-4  # the stored limits are of single precision

    def hashed(c):
        seeds = np.array([language_seed(lang) for lang in c["lang"].to_pylist()], np.uint64)
        return {"h": (seeds ^ np.uint64(1 << 63)).view(np.int64), "low": c["low"], "high": c["high"]}

    rows = map_rows(by_lang.select("lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")),
                    ["lang", "low", "high"], hashed, "h bigint, low float, high float")
    return SortedArrays(write_sorted(rows, folder, "bands", ["low", "high"]))


def _verdicts(langs: list[str | None], means: list[float | None], failed: list[bool], limits: SortedArrays) -> dict:
    seeds = {lang: language_seed(lang or "") for lang in set(langs)}
    wanted = np.array([seeds[lang] for lang in langs], np.uint64)
    mean = np.array([np.nan if m is None else m for m in means], np.float64)
    inside = (mean >= limits.find(wanted, "low")) & (mean <= limits.find(wanted, "high"))
    return {"perplexity": [None if np.isnan(m) else 10.0 ** -m for m in mean.tolist()],
            "kept": (inside & ~np.array(failed, bool)).tolist()}


def judge(scored: DataFrame, limits: SortedArrays) -> DataFrame:
    """``scored`` with ``perplexity`` and ``kept``: base rules passed, and the perplexity within the language's band."""
    def run(c):
        return _verdicts(*(c[k].to_pylist() for k in ("lang", "mean_log10", "base_failed")), limits)

    return add_columns(scored, ["lang", "mean_log10", "base_failed"], run, VERDICT)


def _fitted(docs: DataFrame) -> tuple[Model, DataFrame, SortedArrays]:
    spark = docs.sparkSession
    folder = shared_folder(spark, "quality")
    model = train(docs.select("lang", "text"), ORDER)
    score(docs.withColumn(TEXT_ID, row_id(F.col("text"))), model).drop("text").write.parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    return model, scored, bands(scored, folder)


def quality(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, with all counts, the perplexity and the verdict."""
    _, scored, limits = _fitted(docs)
    return judge(scored, limits).drop("mean_log10", TEXT_ID)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that pass; the texts are scored again where they lie instead of joined to a verdict."""
    model, _, limits = _fitted(docs.select("lang", "text"))
    new = {*BASE, "base_failed", "mean_log10", "perplexity", "kept"}
    aside = {c: f"__own_{c}" for c in docs.columns if c in new}
    judged = score(docs.withColumnsRenamed(aside), model, limits).where("kept")
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
