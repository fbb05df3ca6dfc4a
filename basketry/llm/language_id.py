"""Language identification by Bayesian fusion of text, markup, address suffix and host.

The text likelihood is naive Bayes over hashed byte trigrams, learned from a bounded sample of rows
with a known language; its logarithm is tempered, since neighbouring trigrams repeat each other's
evidence. One more class, ``und``, gives every trigram the same probability and wins where no
language explains the text. What the other evidence is worth is estimated from all rows by grouped
aggregation of the text's soft posteriors:

* declared language: P(declared | language), with pseudo-counts that favour agreement;
* address suffix: P(suffix | language), smoothed towards the suffix's overall share;
* host: P(language | host), smoothed towards its domain, itself smoothed towards all rows; a row's
  own share is left out of its host's and domain's.

Tables of hosts, suffixes and declared values are broadcast while they are small, by their counted
size, else joined so that a hot value's rows stay spread. A row is accepted if its best class is a
language and its posterior reaches ``least``.

Every language of the labelled rows is learned; more than ``max_languages`` raise an error, since
the model is a table of languages by trigrams.

Defined results: null text is empty and is judged by the other evidence alone, but not accepted
without a letter; null host, suffix or declared value are one value of their kind, the declared
one without evidence; a null id stays; repeated rows give repeated results; without labelled rows
everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import bounded_batches, column_parts, join_hot, materialize, slices, text_bytes

BUCKETS = 1 << 13
UNKNOWN = "und"
#: Bytes up to which a table of sums is broadcast.
SMALL_TABLE = 16 << 20

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass
class TextModel:
    """Languages and the logarithm of each one's trigram probabilities; the last row is for ``und``."""

    languages: list[str]
    logs: np.ndarray


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram that has a letter, the text it is of, and each text's letters."""
    raw, offsets = text_bytes(column)
    folded = _FOLD[raw]
    letter = folded != 0x20
    total = np.concatenate([[0], np.cumsum(letter)])
    n = len(raw) - 2
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), total[offsets[1:]] - total[offsets[:-1]]
    text = np.repeat(np.arange(len(column)), np.diff(offsets))
    value = folded.astype(np.uint32)
    key = (value[:n] * np.uint32(0x9E3779B1) + value[1 : n + 1] * np.uint32(0x85EBCA77) + value[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(19)
    use = np.flatnonzero((text[:n] == text[2:]) & (letter[:n] | letter[1 : n + 1] | letter[2:]))
    return key[use].astype(np.int64), text[use], total[offsets[1:]] - total[offsets[:-1]]


def likelihoods(column: pa.Array, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by languages: the logarithm of each text's likelihood; and each text's letters."""
    found, told = [], []
    for part in column_parts(column):
        key, text, letters = trigrams(part)
        found.append(np.stack([np.bincount(text, weights=row[key], minlength=len(part)) for row in logs], axis=1).astype(float))  # counts of nothing are whole numbers
        told.append(letters)
    return np.concatenate(found), np.concatenate(told)


def text_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, max_languages: int = 1024) -> TextModel:
    """Learn all languages, each from a sample of about ``per_language`` ids."""
    bounded_batches(labelled.sparkSession)
    known = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = known.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted(r["lang"] for r in found)
    at = {lang: k for k, lang in enumerate(names)}
    # a row is taken if its id hashes into its language's share of 2^31 values: all rows of a rare one
    share = F.create_map(*(F.lit(x) for r in found for x in (r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 31))))) if found else F.create_map(F.lit(""), F.lit(0))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                key, text, _ = trigrams(part.column("text"))
                langs = part.column("lang").to_pylist()
                for lang in set(langs):
                    own = np.asarray([x == lang for x in langs])
                    sums[lang] = sums.get(lang, 0) + np.bincount(key[own[text]], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    # what comes to the driver is languages times buckets at most
    rows = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    counts = np.zeros((len(names), BUCKETS))
    for r in rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[at[r["lang"]], r["bucket"]] = r["n"]
    shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    # a tenth of each language's probability is spread evenly, for names, numbers and foreign words
    logs = np.log(0.9 * shares + 0.1 / BUCKETS)
    return TextModel(names, np.concatenate([logs, np.full((1, BUCKETS), -np.log(BUCKETS))]))


def evidence(rows: DataFrame, model: TextModel, temper: float = 0.25) -> DataFrame:
    """``rows`` (id, text, declared, suffix, domain, host) with letters, log (tempered likelihoods) and soft (posteriors from text)."""
    bounded_batches(rows.sparkSession)
    given = rows.sparkSession.sparkContext.broadcast(model.logs)  # languages times buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = given.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found, letters = likelihoods(part.column("text"), logs)
                found *= temper
                found -= found.max(axis=1, keepdims=True)
                soft = np.exp(found)
                soft /= soft.sum(axis=1, keepdims=True)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(letters.astype(np.int64)), lists(found), lists(soft)], [*kept, "letters", "log", "soft"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, letters long, log array<double>, soft array<double>")


def _sums(rows: DataFrame, keys: list[str], column: str, width: int, name: str, weight: Column | None = None) -> DataFrame:
    """Element-wise sums of an array column by keys, and n, the rows (or the sum of ``weight``)."""
    n = F.count("*") if weight is None else F.sum(weight)
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col(column)[k]) for k in range(width))).alias(name), n.alias("n"))


def _with(rows: DataFrame, table: DataFrame, keys: list[str], total: int, width: int) -> DataFrame:
    """``rows`` with the sums of ``table`` (keys, sums, n: how many of ``total`` rows have the key)."""
    if table.count() * (8 * width + 64) <= SMALL_TABLE:
        return rows.join(F.broadcast(table.drop("n")), keys)
    return join_hot(rows, table, keys, "n", total)


def identify(rows: DataFrame, model: TextModel, temper: float = 0.25, least: float = 0.5, host_weight: float = 5.0, domain_weight: float = 10.0, declared_weight: float = 20.0, agreement: float = 0.8, suffix_weight: float = 20.0) -> DataFrame:
    """id, text_language (by the text alone), language, confidence, accepted for rows of
    id, text, declared, suffix, domain, host."""
    names = [*model.languages, UNKNOWN]
    width = len(names)
    for c in ("declared", "suffix", "domain", "host"):
        rows = rows.withColumn(c, F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    seen = materialize(evidence(rows, model, temper), "languages")
    # every table below is an aggregate of all rows; hosts with their domain, and what these sum to
    hosts = materialize(_sums(seen, ["domain", "host"], "soft", width, "of_host"), "hosts")
    domains = materialize(_sums(hosts, ["domain"], "of_host", width, "of_domain", F.col("n")).join(hosts.groupBy("domain").agg(F.count("*").alias("hosts")), "domain"), "domains")
    # one row: what the domains sum to, which is also each language's total
    whole = _sums(domains, [], "of_domain", width, "of_all", F.col("n")).first()
    sums, total = np.asarray([x or 0.0 for x in whole["of_all"]]), whole["n"] or 0
    hosts = materialize(_with(hosts.withColumnRenamed("n", "own"), domains.drop("n").withColumnRenamed("hosts", "n"), ["domain"], hosts.count(), width).withColumnRenamed("own", "n"), "hosts-of-domains")
    declared = materialize(_sums(seen, ["declared"], "soft", width, "of_declared"), "declared")
    suffixes = materialize(_sums(seen, ["suffix"], "soft", width, "of_suffix"), "suffixes")
    given = _with(_with(_with(seen, hosts, ["domain", "host"], total, 2 * width), declared, ["declared"], total, width), suffixes, ["suffix"], total, width).select("id", "declared", "letters", "log", "soft", "of_host", "of_domain", "of_declared", "of_suffix")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        called = np.asarray(names, dtype=object)
        for batch in batches:
            n = batch.num_rows
            value = {c: batch.column(c).flatten().to_numpy().reshape(n, width) for c in ("log", "soft", "of_host", "of_domain", "of_declared", "of_suffix")}
            everywhere = (sums + 1) / (sums.sum() + width)
            by_domain = np.maximum(0, value["of_domain"] - value["soft"]) + domain_weight * everywhere
            by_domain /= by_domain.sum(axis=1, keepdims=True)
            by_host = np.maximum(0, value["of_host"] - value["soft"]) + host_weight * by_domain
            by_host /= by_host.sum(axis=1, keepdims=True)
            said = np.asarray(batch.column("declared").to_pylist(), dtype=object)
            # a declared value that names no language agrees with all of them alike
            agree = np.where(said[:, None] == called[None, :], agreement, (1 - agreement) / max(1, width - 1))
            agree[~np.isin(said, called)] = 1 / width
            of_declared = np.log((value["of_declared"] + declared_weight * agree) / (sums + declared_weight))
            of_declared[said == ""] = 0
            usual = value["of_suffix"].sum(axis=1, keepdims=True) / max(1e-9, sums.sum())
            of_suffix = np.log((value["of_suffix"] + suffix_weight * usual) / (sums + suffix_weight))
            total = value["log"] + np.log(by_host) + of_declared + of_suffix
            posterior = np.exp(total - total.max(axis=1, keepdims=True))
            posterior /= posterior.sum(axis=1, keepdims=True)
            letters = batch.column("letters").to_numpy()
            language, confidence = called[posterior.argmax(axis=1)], posterior.max(axis=1)
            by_text = np.where(letters > 0, called[value["soft"].argmax(axis=1)], UNKNOWN)
            accepted = (language != UNKNOWN) & (confidence >= least) & (letters > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(by_text.tolist(), pa.string()), pa.array(language.tolist(), pa.string()), pa.array(confidence), pa.array(accepted.astype(bool))], ["id", "text_language", "language", "confidence", "accepted"])

    return given.mapInArrow(fuse, f"id {given.schema['id'].dataType.simpleString()}, text_language string, language string, confidence double, accepted boolean")


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Evidence columns of web pages: visible text, declared language, and the parts of the address."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.lower(F.coalesce(F.col(url_col), F.lit("")))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]+>|&#?[a-z0-9]+;", " ")
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), r"^www\.", "")
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    declared = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return pages.select(F.col(id_col).alias("id"), text.alias("text"), declared.alias("declared"), F.element_at(labels, -1).alias("suffix"), domain.alias("domain"), host.alias("host"))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Evidence columns of documents: the language they come with is declared, and the source is the host."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("domain"), F.col(source_col).alias("host"))
