"""Language ID by Bayesian evidence fusion: text, declared markup language, address suffix, host.

For each language the log posterior adds up
* the text: naive Bayes over hashed words, beginnings and endings of words, fitted on at most ``max_rows``
  distinct texts of each declared language (those with the smallest hashes); all languages give buckets that they
  have not seen the same small share. Its weight is that of at most ``CAP`` words, as words are not independent;
* the declaration: how often texts of that language declare this one, counted over all rows and smoothed,
  so a declaration counts as much as it is found to be worth; an unknown or missing one counts nothing;
* the address: a prior for the host, smoothed towards that of its domain (last two labels), this one
  towards its suffix (last label), that one towards the whole corpus. All four levels are counts of the
  texts' own best languages, by grouped aggregation; a level with n rows keeps ``n / (n + STRENGTH)``
  of its own.
Beside the languages stands a background of equally likely buckets, with the prior ``BACKGROUND``: what no language
explains better, as random letters or an unknown script, is in no known language.

Every language that ``LEAST_ROWS`` rows declare is in the model, so that one stray code doesn't become a
language; beyond that their number has no bound but memory (``2 ** BITS`` numbers a language in each worker). Texts are
scored where they lie, with the model broadcast; of a row only its text goes through Python. The prior of hosts is broadcast after a check of its size and
joined by a shuffle beyond it, where adaptive execution splits a hot host.

Defined results: null or empty text, or text without words: language ``und``, posterior 0, not kept. Text that
the background explains best: ``und``, with the background's posterior, not kept. A null host: the corpus prior. No
row declares a language: everything is ``und``. Ties go to the code that sorts first. Repeated rows count as often as they come. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 15
#: Texts fitted for each declared language, at most.
MAX_ROWS = 2_000
CAP = 30
#: Rows that must declare a language for it to be one.
LEAST_ROWS = 3
#: Share of a language's words that fall on buckets it has not seen, spread evenly over all.
UNSEEN = 0.05
#: Prior of the background.
BACKGROUND = 0.001
STRENGTH = 20.0
#: A text is kept if the posterior of its best language reaches this.
MIN_POSTERIOR = 0.5
HOSTS_SENT = 200_000
EDGE = b".,;:!?\"'()[]{}<>#$%&*|"
CACHE_WORDS = 300_000


class _Words(dict):
    """word -> row of buckets: the cleaned word, its first and its last three letters. What has nothing but
    signs is no word."""

    def __init__(self) -> None:
        self.buckets = np.empty((1 << 16, 3), np.int32)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.buckets):
            self.buckets = np.concatenate((self.buckets, np.empty_like(self.buckets)))
        letters = word.strip(EDGE).decode("utf-8", "replace").lower()
        self.buckets[i] = [xxhash.xxh32_intdigest(x, k) >> 32 - BITS for k, x in enumerate((letters, letters[:3], letters[-3:]))] if letters else -1
        self[word] = i
        return i

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        words = text.split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))  # may make buckets larger
        found = self.buckets[at]
        return found[found[:, 0] >= 0]


_WORDS = _Words()


def _forget() -> None:
    _WORDS.clear()


def _language(declared: Column) -> Column:
    """en-GB, EN_us -> en."""
    return F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log shares of (bucket, language), the background last. rows: text, declared."""
    known = rows.select("text", _language(F.col("declared")).alias("l"), F.xxhash64("text").alias("h")).where("l <> '' AND text IS NOT NULL")
    # a distinct text counts once, as what most of its rows declare
    owned = known.groupBy("h", "l").agg(F.count("h").alias("n")).groupBy("h").agg(F.max_by("l", F.struct("n", "l")).alias("l"), F.max("n").alias("n"))
    owned = common.cut(owned)
    sizes = {r["l"]: r["texts"] for r in owned.groupBy("l").agg(F.count("h").alias("texts"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS).collect()}
    if not sizes:
        return [], np.zeros((1 << BITS, 1), np.float32)
    limits = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, common.below(max_rows / n))))
    drawn = owned.where(F.col("h") <= F.try_element_at(limits, F.col("l")))  # about max_rows for each language
    picked = common.join_small(known.select("h", "text"), drawn, ["h"], "inner").groupBy("h").agg(F.first("l").alias("l"), F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for t, l in zip(common.texts(b["text"]), b["l"].to_pylist(), strict=True):
                seen[l] = seen.get(l, 0) + np.bincount(_WORDS.of(t).ravel(), minlength=1 << BITS)
        for l, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["l", "at", "n"])
        _forget()

    # at most a row for each bucket and language
    counts = picked.select("text", "l").mapInArrow(count, "l string, at int, n long").groupBy("l", "at").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["l"] for r in counts})
    place, table = {l: i for i, l in enumerate(names)}, np.zeros((1 << BITS, len(names) + 1))
    for r in counts:
        table[r["at"], place[r["l"]]] = r["n"]
    table[:, -1] = 1.0
    table /= table.sum(axis=0)
    table[:, :-1] = (1 - UNSEEN) * table[:, :-1] + UNSEEN / (1 << BITS)
    return names, np.log(table).astype(np.float32)


def score(rows: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """The columns of rows but the text; n_words; text_ll: log likelihood by language, of weight CAP at most;
    back_ll: that of the background."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("n_words long, text_ll array<double>, back_ll double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sent.value
        for b in batches:
            n, ll = [], [np.zeros((0, table.shape[1]))]
            for t in common.texts(b):
                at = _WORDS.of(t)
                n.append(len(at))
                ll.append((table[at.ravel()].sum(axis=0) * (min(len(at), CAP) / len(at)) if len(at) else np.zeros(table.shape[1])).astype(float)[None])
            each = np.concatenate(ll)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(list(each[:, :-1]), pa.list_(pa.float64())), pa.array(each[:, -1], pa.float64())], names=["n_words", "text_ll", "back_ll"])
        _forget()

    others = [c for c in common.columns(rows.drop("text"))]
    return rows.select(*others, scored("text").alias("_scored")).select(*others, "_scored.*")


def _best(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _smoothed(own: Column, above: Column) -> Column:
    """own: counts by language; above: shares of the level above."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda n, p: (n + STRENGTH * p) / (total + STRENGTH))


def priors(scored: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """(host, prior: log shares), and the corpus's own, for rows with no host."""
    sums = F.array(*(F.sum(F.col("c")[i]) for i in range(n))).alias("c")
    voted = scored.where("n_words > 0").select("host", F.array(*(F.when(_best(F.col("text_ll")) == i, 1.0).otherwise(0.0) for i in range(n))).alias("c"))
    labels = F.split("host", r"\.")
    hosts = voted.groupBy("host").agg(sums).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")).withColumn("suffix", F.element_at(labels, -1))
    hosts = common.cut(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(sums)
    suffixes = domains.groupBy("suffix").agg(sums)
    root = (suffixes.agg(sums).first() or [None])[0] or [0.0] * n
    root = [(float(x or 0.0) + 1.0) / (sum(float(y or 0.0) for y in root) + n) for x in root]
    whole = F.array(*map(F.lit, root))
    suffixes = suffixes.where("suffix IS NOT NULL").select("suffix", _smoothed(F.col("c"), whole).alias("above"))
    domains = common.join_small(domains, suffixes, ["suffix"], "inner").select("domain", _smoothed(F.col("c"), F.col("above")).alias("above"))
    hosts = common.join_small(hosts, domains, ["domain"], "inner").select("host", F.transform(_smoothed(F.col("c"), F.col("above")), lambda p: F.log(p)).alias("prior"))
    return hosts, F.transform(whole, lambda p: F.log(p))


def identify(rows: DataFrame, max_rows: int = MAX_ROWS, min_posterior: float = MIN_POSTERIOR, wanted: list[str] | None = None) -> DataFrame:
    """rows: text, declared, host and any others. Returns the others, declared, host, lang, posterior,
    text_lang (by the text alone), kept (sure enough, and of a wanted language if some are given). Other
    columns named like a result are dropped."""
    spark = rows.sparkSession
    common.small_batches(spark)
    rows = rows.drop("n_words", "text_ll", "back_ll", "prior", "lang", "posterior", "text_lang", "kept", "_f", "_p", "_b")
    names, table = fit(rows, max_rows)
    scored = common.stored(score(rows, names, table), "langid")
    n, others = len(names), [c for c in rows.columns if c != "text"]
    if not n:
        return scored.select(*others, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_lang"), F.lit(False).alias("kept"))
    codes = F.array(*map(F.lit, names))
    said = F.array_position(codes, _language(F.coalesce("declared", F.lit("")))).cast("int") - 1  # -1: unknown
    seen = np.ones((n, n))
    for r in scored.where("n_words > 0").select(said.alias("said"), _best(F.col("text_ll")).alias("best")).where("said >= 0").groupBy("said", "best").count().collect():
        seen[r["said"], r["best"]] += r["count"]
    declared = np.log(seen / seen.sum(axis=0))  # of a text's language, what it declares
    worth = F.array(*(F.array(*map(F.lit, row)) for row in declared.tolist()), F.array(*[F.lit(0.0)] * n))
    hosts, whole = priors(scored, n)
    joined = common.join_small(scored, hosts, ["host"], "left", HOSTS_SENT)
    fused = _add(_add(F.col("text_ll"), F.coalesce("prior", whole)), F.element_at(worth, F.when(said < 0, n + 1).otherwise(said + 1)))
    joined = joined.withColumn("_f", fused)
    # the background may declare any language, or none that is known, alike
    joined = joined.withColumn("_b", F.col("back_ll") + float(np.log(BACKGROUND)) - F.when(said < 0, 0.0).otherwise(float(np.log(n))))
    top = F.greatest(F.array_max("_f"), F.col("_b"))
    all_ = F.aggregate("_f", F.exp(F.col("_b") - top), lambda a, x: a + F.exp(x - top))
    joined = joined.withColumn("_p", F.exp(F.greatest(F.array_max("_f"), F.col("_b")) - top) / all_)
    some, known = F.col("n_words") > 0, F.col("n_words").isNotNull() & (F.col("n_words") > 0) & (F.array_max("_f") >= F.col("_b"))
    lang = F.when(known, F.element_at(codes, _best(F.col("_f")) + 1)).otherwise(F.lit("und"))
    out = joined.select(*others, lang.alias("lang"), F.when(some, F.col("_p")).otherwise(F.lit(0.0)).alias("posterior"), F.when(some, F.element_at(codes, _best(F.col("text_ll")) + 1)).otherwise(F.lit("und")).alias("text_lang"))
    fine = (F.col("posterior") >= min_posterior) & (F.col("lang") != "und")
    return out.withColumn("kept", fine if wanted is None else fine & F.col("lang").isin(wanted))


def page_text(html: Column) -> Column:
    """Visible text, roughly: scripts, styles, comments and tags cut, the commonest entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(by))
    return bare


def of_pages(pages: DataFrame) -> DataFrame:
    from .urlrange import host_of

    return pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
        page_text(F.col("html")).alias("text"), F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1).alias("declared"), host_of(F.col("url")).alias("host"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents declare their lang column; their source stands for the host."""
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page; one row each."""
    rows = of_documents(common.read(spark, sf_dir, "documents")).unionByName(of_pages(common.read(spark, sf_dir, "pages")))
    return identify(rows)
