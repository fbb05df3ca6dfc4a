"""Quality rules by distribution divergence.

Each document's histograms over character classes and over the common words of its language are
compared with that language's references by Jensen-Shannon distance (the square root of the
divergence in bits, 0 to 1). Common words and references are learned from the table, by grouped
aggregation over all of it:

* a language's common words are the ``common`` words that most of its documents hold;
* a language's references are the medians of its documents' shares, over all that pass the base
  rules, scaled to a sum of 1. Medians are read from counts of shares in bins, which are sums, so
  that they are the same however rows are dealt.

Languages of fewer than ``min_documents`` rows share one vocabulary and one reference. Guards:
documents of fewer than ``min_words`` words fail by rule, and the common-word distance is judged
only from ``min_common_words`` words on, below which it is mostly noise.

The work is two scans that count on Arrow buffers, aggregates, and arithmetic in SQL functions
over the small feature rows. What is broadcast has a row per language, of which there may be
``max_languages``; more raise an error.

Defined results: null text has no words and fails; a null language is one of those that share; a
language whose reference is empty judges nothing; words are compared without the case of ASCII
letters, ties go to the smaller word; repeated rows give repeated results, and each counts;
columns other than id, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import Words, bounded_batches, materialize, slices, span_hash, text_bytes
from basketry.llm.text_stats import CLASSES, Stats

#: Common words by language, features of the classifier.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "in", "zu", "den", "mit", "von", "ist", "des", "sich", "auf", "für", "nicht", "als", "auch", "es", "an", "er", "dem", "ein", "eine", "im"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "at", "are", "this", "from", "or", "an", "a", "have", "not"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es", "lo", "como", "más", "o"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "plus", "ce", "il", "avec", "ne"],
}
#: What the languages that share a reference are called; no language of a row, as it holds a space.
OTHER = "all others"
#: Bins of the square root of a share, from which medians are read.
BINS = 1000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, own: list[str]) -> DataFrame:
    language = F.when(F.col(lang_col).isin(*own), F.col(lang_col)).otherwise(F.lit(OTHER)) if own else F.lit(OTHER)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), language.alias("language"))


def own_languages(docs: DataFrame, lang_col: str, min_documents: int, max_languages: int) -> list[str]:
    """Languages that have a reference of their own, in ascending order."""
    known = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).count().filter(F.col("lang").isNotNull() & (F.col("count") >= min_documents))
    found = known.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages have {min_documents} documents")
    return sorted(r["lang"] for r in found)


def common_words(rows: DataFrame, common: int) -> dict[str, list[str]]:
    """Of each language of ``rows`` (text, language): the words that most documents hold, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column("text"))
                words = Words(_LOWER[raw], offsets)
                if not len(words.start):
                    continue
                doc = np.repeat(np.arange(part.num_rows), words.count)
                h, first, word = np.unique(words.hash, return_index=True, return_inverse=True)
                held = np.unique(doc.astype(np.int64) * len(h) + word)  # each word of a document once
                language = part.column("language").dictionary_encode()
                langs = language.dictionary.to_pylist()
                seen = np.bincount(language.indices.to_numpy()[held // len(h)].astype(np.int64) * len(h) + held % len(h), minlength=len(langs) * len(h))
                some = np.flatnonzero(seen)
                at = first[some % len(h)]
                told = [words.raw[a:b].tobytes().decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(langs, dtype=object)[some // len(h)].tolist(), pa.string()), pa.array(told, pa.string()), pa.array(seen[some].astype(np.int64))], ["language", "word", "n"])

    counted = rows.select("text", "language").mapInArrow(run, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    # each task keeps its own best before any shuffle
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))).filter(F.col("place") <= common)
    out: dict[str, list[str]] = {}
    for r in best.orderBy("language", "place").collect():
        out.setdefault(r["language"], []).append(r["word"])
    return out


def features(rows: DataFrame, vocabulary: dict[str, list[str]], common: int) -> DataFrame:
    """doc_id, language, the exact counts of the base rules, and the two histograms of every row of doc_id, text, language."""
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang, words in vocabulary.items():
        cuts = np.cumsum([0, *(len(w.encode()) for w in words)])
        h = span_hash(np.frombuffer("".join(words).encode(), dtype=np.uint8), cuts[:-1], cuts[1:])
        order = np.argsort(h)
        tables[lang] = h[order], order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Stats(part.column("text"))
                folded = Words(_LOWER[s.raw], s.offsets).hash
                langs = np.asarray(part.column("language").to_pylist(), dtype=object)
                doc = np.repeat(np.arange(part.num_rows), s.n_words)
                words = np.zeros((part.num_rows, common + 1), dtype=np.int64)
                for lang in set(langs.tolist()) & set(tables):
                    h, which = tables[lang]
                    mine = np.flatnonzero((langs == lang)[doc])
                    at = np.minimum(np.searchsorted(h, folded[mine]), len(h) - 1)
                    hit = h[at] == folded[mine]
                    words += np.bincount(doc[mine][hit] * (common + 1) + which[at[hit]], minlength=words.size).reshape(words.shape)
                words[:, common] = s.n_words - words.sum(axis=1)
                columns = {
                    "doc_id": part.column("doc_id"), "language": part.column("language"),
                    "n_words": pa.array(s.n_words), "word_chars": pa.array(s.word_chars), "n_symbols": pa.array(s.n_symbols),
                    "n_dup_lines": pa.array(s.n_dup_lines), "n_repeat_words": pa.array(s.n_repeat_words),
                    "kinds": _lists(s.classes.astype(np.int32).ravel(), len(CLASSES)), "words": _lists(words.astype(np.int32).ravel(), common + 1),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, kinds array<int>, words array<int>")


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))


def _shares(column: str) -> Column:
    """A histogram's counts as shares of their sum."""
    total = F.aggregate(F.col(column), F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(F.col(column), lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares: the root of their Jensen-Shannon divergence in bits."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    sums = F.aggregate(F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), sums / 2))


def references(counted: DataFrame, common: int) -> dict[str, tuple[list[float], list[float]]]:
    """Of each language, the shares (character classes, common words) typical of all its documents that pass the base rules.

    Each bin's reference is the median of its share over documents, which junk moves less than a
    mean: the lower edge of the first bin by whose end half of the documents are reached.
    """
    width = len(CLASSES) + common + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = np.asarray(batch.column("language").to_pylist(), dtype=object)
            both = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float) for c in ("kinds", "words")]
            share = np.concatenate([x / np.maximum(1, x.sum(axis=1, keepdims=True)) for x in both], axis=1)
            place = np.minimum(BINS, np.floor(np.sqrt(share) * BINS)).astype(np.int64) + np.arange(width) * (BINS + 1)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(place[langs == lang].ravel(), minlength=width * (BINS + 1))
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"language": pa.array([lang] * len(at), pa.string()), "place": pa.array(at.astype(np.int32)), "n": pa.array(n[at].astype(np.int64))})

    rows = counted.filter(~F.col("base_failed")).select("language", "kinds", "words").mapInArrow(run, "language string, place int, n long")
    # what comes to the driver is a median for each language and bin
    summed = rows.groupBy("language", "place").agg(F.sum("n").alias("n")).select("language", F.floor(F.col("place") / (BINS + 1)).cast("int").alias("part"), F.pmod("place", F.lit(BINS + 1)).alias("bin"), "n")
    upto = Window.partitionBy("language", "part").orderBy("bin")
    half = summed.select("language", "part", "bin", F.sum("n").over(upto).alias("reached"), F.sum("n").over(Window.partitionBy("language", "part")).alias("all")).filter(2 * F.col("reached") >= F.col("all"))
    medians: dict[str, np.ndarray] = {}
    for r in half.groupBy("language", "part").agg(F.min("bin").alias("bin")).collect():
        medians.setdefault(r["language"], np.zeros(width))[r["part"]] = (r["bin"] / BINS) ** 2
    cut = lambda x: (x / x.sum()).tolist() if x.sum() else x.tolist()
    return {lang: (cut(x[: len(CLASSES)]), cut(x[len(CLASSES) :])) for lang, x in medians.items()}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, min_common_words: int = 50, common: int = 24, min_documents: int = 50, max_languages: int = 1024, kinds_limits: tuple[float, float, float] = (0.10, 0.6, 0.30), words_limits: tuple[float, float, float] = (0.14, 1.1, 1.6)) -> DataFrame:
    """Every row's counts, distances and verdict: kept, or base_failed, or not kept by divergence.

    The noise of a histogram falls with the root of the number of words, and the limits with it.
    A document goes if both distances pass their base plus the second number over that root, or
    if the class distance passes its third number, or the word distance its base plus the third
    number over that root.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _rows(docs, id_col, text_col, lang_col, own_languages(docs, lang_col, min_documents, max_languages))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = materialize(features(rows, common_words(rows, common), common).withColumn("base_failed", failed), "quality-features")
    typical = references(counted, common)
    told = spark.createDataFrame([(lang, *x) for lang, x in sorted(typical.items())], "language string, kinds_reference array<double>, words_reference array<double>")
    # a row per language that has a reference of its own, and one more
    judged = counted.join(F.broadcast(told), "language", "left")
    judged = judged.withColumn("kinds_distance", F.round(jensen_shannon(_shares("kinds"), F.col("kinds_reference")), 6)).withColumn("words_distance", F.when(F.col("n_words") >= min_common_words, F.round(jensen_shannon(_shares("words"), F.col("words_reference")), 6)))
    noise = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    kinds, words = F.coalesce(F.col("kinds_distance"), F.lit(0.0)), F.coalesce(F.col("words_distance"), F.lit(0.0))
    both = (kinds > kinds_limits[0] + kinds_limits[1] * noise) & (words > words_limits[0] + words_limits[1] * noise)
    far = both | (kinds > kinds_limits[2]) | (words > words_limits[0] + words_limits[2] * noise)
    return judged.select("doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kinds_distance", "words_distance", (~F.col("base_failed") & ~far).alias("kept"))


def oracle(docs: str, common: int = 24, min_documents: int = 50, kinds_limits: tuple[float, float, float] = (0.10, 0.6, 0.30), words_limits: tuple[float, float, float] = (0.14, 1.1, 1.6)) -> str:
    """DuckDB SQL for quality_rules(docs) with its other defaults; ``docs`` is a table."""
    # in the order of the classes, but for other ASCII characters, which are what is left
    patterns = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09\x0B-\x0D]", r"\n", r"[.,;:!?''\"()-]", "[#*$%&|<>]", None, r"[^\x00-\x7F]"]
    left = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    rest = "length(t)" + "".join(f" - ({left(p)})" for p in patterns if p)
    kinds = ", ".join(rest if p is None else left(p) for p in patterns)
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    both = "kd > {0} + {1} / nz AND wd > {2} + {3} / nz".format(*kinds_limits[:2], *words_limits[:2])
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM {docs}),
own AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) >= {min_documents}),
l AS MATERIALIZED (SELECT r, doc_id, t, CASE WHEN lang IN (SELECT lang FROM own) THEN lang ELSE '{OTHER}' END AS language, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [{kinds}] AS kinds FROM d),
x AS MATERIALIZED (SELECT r, language, unnest(w) AS word, unnest(range(len(w))) AS i FROM l),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM l) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
y AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
tw AS (SELECT r, i FROM y WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rp AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM tw CROSS JOIN range(3) s(k) GROUP BY 1),
b AS MATERIALIZED (SELECT l.r, doc_id, language, kinds, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, kinds[7] AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed FROM l LEFT JOIN ln USING (r) LEFT JOIN rp USING (r)),
f AS MATERIALIZED (SELECT r, language, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM x),
v AS MATERIALIZED (SELECT language, word, row_number() OVER (PARTITION BY language ORDER BY n DESC, word) AS place FROM (SELECT language, word, count(DISTINCT r) AS n FROM f GROUP BY 1, 2) QUALIFY place <= {common}),
h AS (SELECT r, place, count(*) AS n FROM f JOIN v USING (language, word) GROUP BY 1, 2),
z AS MATERIALIZED (
  SELECT b.r, language, base_failed, 'kinds' AS part, k AS place, CASE WHEN list_sum(kinds) > 0 THEN kinds[k] / list_sum(kinds) ELSE 0 END AS share FROM b CROSS JOIN range(1, {len(CLASSES) + 1}) s(k)
  UNION ALL SELECT b.r, language, base_failed, 'words', k, CASE WHEN n_words > 0 THEN coalesce(h.n, 0) / n_words ELSE 0 END FROM b CROSS JOIN range(1, {common + 1}) s(k) LEFT JOIN h ON h.r = b.r AND h.place = k
  UNION ALL SELECT b.r, language, base_failed, 'words', {common + 1}, CASE WHEN n_words > 0 THEN (n_words - coalesce(u.n, 0)) / n_words ELSE 0 END FROM b LEFT JOIN (SELECT r, sum(n) AS n FROM h GROUP BY 1) u ON u.r = b.r),
m AS (SELECT language, part, place, min(bin) AS bin FROM (SELECT language, part, place, floor(sqrt(share) * {BINS}) AS bin, row_number() OVER (PARTITION BY language, part, place ORDER BY share) AS k, count(*) OVER (PARTITION BY language, part, place) AS many FROM z WHERE NOT base_failed) WHERE 2 * k >= many GROUP BY 1, 2, 3),
q AS (SELECT language, part, place, coalesce((bin / {BINS}) ** 2 / nullif(sum((bin / {BINS}) ** 2) OVER (PARTITION BY language, part), 0), 0) AS reference FROM m),
j AS (SELECT r, round(sqrt(greatest(0, sum(CASE WHEN part = 'kinds' THEN js END) / 2)), 6) AS kinds_distance, round(sqrt(greatest(0, sum(CASE WHEN part = 'words' THEN js END) / 2)), 6) AS words_distance
  FROM (SELECT r, part, {term('share', 'reference')} + {term('reference', 'share')} AS js FROM z JOIN q USING (language, part, place)) GROUP BY 1),
e AS (SELECT b.*, kinds_distance, CASE WHEN n_words >= 50 THEN words_distance END AS words_distance, coalesce(kinds_distance, 0) AS kd, CASE WHEN n_words >= 50 THEN coalesce(words_distance, 0) ELSE 0 END AS wd, sqrt(greatest(n_words, 1)) AS nz FROM b LEFT JOIN j USING (r))
SELECT doc_id, language, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kinds_distance, words_distance, NOT base_failed AND NOT (({both}) OR kd > {kinds_limits[2]} OR wd > {words_limits[0]} + {words_limits[2]} / nz) AS kept FROM e"""
