"""License scans, chat formatting, language, quality rules and classifier."""

import collections
import hashlib
import os
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import chat_format, language_id, license_scan, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- licenses


def scan(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, w string, class int")
    return {(r["doc_id"], r["license"]): r for r in license_scan.license_scan(docs, **more).collect()}


def test_every_template_is_found_anywhere(spark):
    draw = random.Random(8)
    noise = lambda n: " ".join("".join(draw.choices("bcdfghk", k=6)) for _ in range(n))
    rows = [(k, f"{noise(draw.randint(0, 50))} {text} {noise(draw.randint(0, 50))}") for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    found = scan(spark, rows)
    for k, (name, _) in enumerate(license_scan.TEMPLATES):
        assert found[k, name]["containment"] == 1.0


def test_altered_notices_and_clean_texts(spark):
    name, text = max(license_scan.TEMPLATES, key=lambda t: len(t[1]))
    words = text.split()
    rows = [(1, " ".join([*words[:5], "changed", *words[6:]])), (2, " ".join(words[: len(words) // 2])), (3, "A license is a permission to use software, under terms that the owner sets."), (4, None), (5, ""), (None, text), (6, "Licensed under CC BY 4.0."), (6, "Licensed under CC BY 4.0."), (7, "licensed UNDER cc-by-nc 4 0 " * 400)]
    found = scan(spark, rows)
    assert 0.8 <= found[1, name]["containment"] < 1 and (None, name) in found
    assert set(found) == {(1, name), (None, name), (6, "CC-BY-4.0"), (7, "CC-BY-NC-4.0")}
    assert scan(spark, [(1, None)]) == {}


def test_bands_are_certain():
    for length, bands, group in license_scan._classes(license_scan.TEMPLATES, 5, 0.8, 0.99999):
        width, _ = license_scan.window_shape(length)
        shortest = min(len(re.findall("[a-z0-9]+", t.lower())) for _, _, t in group)
        shared = int(np.ceil(0.8 * (shortest - 4)))
        similarity = shared / (width - 4 + shortest - 4 - shared)
        assert (1 - similarity) ** bands <= 1.0001e-5
    with pytest.raises(ValueError):
        license_scan._classes([("x", "too short")], 5, 0.8, 0.99)


def test_short_notices(spark):
    draw = random.Random(9)
    noise = lambda n: " ".join("".join(draw.choices("bcdfghk", k=6)) for _ in range(n))
    short = license_scan.SHORT_TEMPLATES
    rows = [(k, f"{noise(draw.randint(0, 90))} {text} {noise(draw.randint(0, 90))}") for k, (_, text) in enumerate(short)]
    rows += [(20, "ALL RIGHTS\n  reserved"), (21, "all the rights reserved"), (22, "All rights. Licensed under the MIT License."), (23, "SPDX-License-Identifier: X"), (None, "spdx license identifier mit"), (24, "rights reserved all"), (25, "SPDX-License-Identifier: Apache-2.0")]
    found = scan(spark, rows)
    assert set(found) == {*((k, name) for k, (name, _) in enumerate(short)), (20, "all-rights-reserved"), (22, "MIT"), (None, "MIT"), (25, "Apache-2.0")}
    assert all(r["containment"] == 1.0 for r in found.values())
    assert found[20, "all-rights-reserved"]["first_word"] == 0 and found[20, "all-rights-reserved"]["n_words"] == 3
    assert set(scan(spark, [(1, "one MIT two"), (2, "none")], templates=[("MIT", "MIT")])) == {(1, "MIT")}
    with pytest.raises(ValueError):
        scan(spark, rows, templates=[("x", " - ")])
    altered = next(text for name, text in license_scan.TEMPLATES if name == "proprietary").replace("means", "way")
    assert set(scan(spark, [(1, altered)])) == {(1, "proprietary"), (1, "all-rights-reserved")}


def test_notices_against_their_sql(spark):
    """Cut, altered and mixed notices in long texts, with repeated and null ids."""
    import duckdb

    draw = random.Random(15)
    every = [t for _, t in license_scan.TEMPLATES + license_scan.SHORT_TEMPLATES]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(draw.randint(1, 4)):
            words = draw.choice(every).split()
            for _ in range(draw.randint(0, max(1, len(words) // 9))):
                words[draw.randrange(len(words))] = "other"
            parts += ["noise " * draw.randint(0, 40), " ".join(words[: draw.randint(len(words) * 3 // 4, len(words))])]
        rows.append((k // 2 if k % 7 else None, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, ("word " * 500 + every[0]) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", rows)
    found = [tuple(r) for r in license_scan.license_scan(docs).collect()]
    assert len(found) > 60 and sorted(map(repr, found)) == sorted(map(repr, con.sql(license_scan.oracle("docs")).fetchall()))
    assert license_scan.license_scan(docs.filter("false")).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_last_lines_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"(^|\n)All rights reserved\.$")).collect()}
    found = {r["doc_id"] for r in license_scan.license_scan(docs).filter("license = 'all-rights-reserved'").collect()}
    assert planted and planted <= found


# --- conversations


def conversations():
    draw = random.Random(6)
    marks = ["### ", "</turn>", "\\", "#", ": ", "\n", "ß", "日", "word ", "### Assistant: </turn> ok", "\\h", "\\s", "\\e\\", "<", "</turn"]
    rows = []
    for c in range(30):
        for t in range(draw.randint(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else draw.choice(["user", "assistant", "tool: x"])
            rows.append((c, t, role, "".join(draw.choices(marks, k=draw.randint(0, 60)))))
    rows += [(90, 0, "system", "alone"), (91, 0, None, None), (91, None, "assistant", "no turn"), (None, 1, "user", "who"), (92, 0, "assistant", "same"), (92, 0, "assistant", "same"), (93, 0, "user", "y" * 9000), (93, 1, "assistant", "z" * 9000)]
    return rows


def digests(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for c, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(1024, 128), (60, 10), (100000, 0)])
def test_chat_reads_back(spark, budget, history):
    rows = conversations()
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, cell string").repartition(3)
    formatted = chat_format.windows(turns, budget, history).persist()
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.read_back(formatted).collect()}
    assert found == digests(rows)
    for r in formatted.collect():
        # a window is over budget only for a turn that is never cut
        assert r["n_tokens"] <= budget or r["n_turns"] == 1 + (r["window"] == 0 and r["formatted"].startswith("### system: "))
        assert all(0 <= s["start"] and s["start"] + s["length"] <= len(r["formatted"]) for s in r["loss"])
        assert r["formatted"].count("</turn>\n") == r["n_turns"] + r["n_repeated"]


def test_chat_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.windows(turns).collect() == [] and chat_format.read_back(chat_format.windows(turns)).collect() == []


def test_windows_keep_the_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be kind"), *((1, t, "user" if t % 2 else "assistant", f"turn {t} " + "x" * 40) for t in range(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.windows(turns, 100, 20).orderBy("window").collect()
    assert len(found) > 1 and all(r["formatted"].startswith("### system: be kind</turn>\n") for r in found)
    assert found[0]["n_repeated"] == 0 and found[1]["n_repeated"] == 2
    assert [r["n_turns"] for r in found][0] >= 2 and sum(r["n_turns"] for r in found) == 9


# --- languages


SAMPLES = {"en": "the house and the garden of this old town with many people that are here for the summer ", "fr": "la maison et le jardin de cette vieille ville avec les gens qui sont dans une rue pour un jour ", "de": "das haus und der garten in dieser alten stadt mit den leuten die für einen tag auf die straße gehen "}


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(k, SAMPLES[lang] * 3, lang) for k, lang in enumerate(["en", "fr", "de"] * 5)]
    return language_id.text_model(spark.createDataFrame([*rows, (None, "x", "en"), (99, None, "fr"), (98, "y", None)], "doc_id long, text string, lang string"))


def test_languages_of_pages(spark, languages):
    page = lambda lang, text: f'<!DOCTYPE html><html class="a" lang="{lang}"><style>the the the</style><script>if (a < b) the()</script><p>{text}&amp;</p>'
    rows = [(k, f"https://www.host{k % 3}.example.{['com', 'org', 'de'][k % 3]}/p", page(lang, SAMPLES[lang])) for k, lang in enumerate(["en", "fr", "de"] * 4)]
    rows += [(50, "http://host2.example.de/x", page("de", "haus")), (51, None, None), (52, "http://host0.example.com/", page("de", SAMPLES["en"])), (53, "no address", "<p>漢字かな交じり文をここに書く、漢字かな交じり文</p>"), (None, "http://host1.example.org", SAMPLES["fr"]), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    found = collections.defaultdict(list)
    for r in language_id.identify(language_id.page_rows(pages), languages).collect():
        found[r["id"]].append(r)
    for k in range(12):
        assert {(r["language"], r["accepted"]) for r in found[k]} == {(["en", "fr", "de"][k % 3], True)}
    assert len(found[0]) == 2 and found[50][0]["language"] == "de" and found[52][0]["language"] == "en"
    assert not found[51][0]["accepted"] and not found[53][0]["accepted"] and found[None][0]["language"] == "fr"


def test_language_of_short_documents_follows_other_evidence(spark, languages):
    rows = [(k, SAMPLES["fr"], "fr", "a") for k in range(20)] + [(50, "Zz.", "fr", "a"), (51, "", "fr", "a"), (52, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["id"]: r for r in language_id.identify(language_id.document_rows(docs), languages).collect()}
    assert found[50]["language"] == "fr" and found[50]["accepted"]
    assert not found[51]["accepted"] and not found[52]["accepted"]
    empty = docs.filter("false")
    assert language_id.identify(language_id.document_rows(empty), languages).collect() == []
    assert language_id.text_model(empty).languages == []


def test_all_languages_are_learned(spark):
    draw = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k}": ["".join(draw.choices(letters, k=5)) for _ in range(30)] for k in range(40)}
    rows = [(40 * n + k, " ".join(draw.choices(words[f"l{k}"], k=60)), f"l{k}", "h") for n in range(3) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.text_model(docs)
    assert len(model.languages) == 40
    found = {r["id"]: r["text_language"] for r in language_id.identify(language_id.document_rows(docs), model).collect()}
    assert all(found[d] == lang for d, _, lang, _ in rows)
    with pytest.raises(ValueError):
        language_id.text_model(docs, max_languages=39)


@pytest.mark.parametrize("small", [1 << 24, 0])
def test_fusion_by_hand(spark, languages, monkeypatch, small):
    """What identify() says against the formulas, row by row, with tables broadcast or joined."""
    monkeypatch.setattr(language_id, "SMALL_TABLE", small)
    draw = random.Random(13)
    rows = []
    for k in range(60):
        lang = draw.choice(list(SAMPLES))
        words = SAMPLES[lang].split()
        host = draw.choice(["a.x.com", "a.x.com", "a.x.com", "b.x.com", "c.y.de", None])
        rows.append((k, " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 30]))), draw.choice([lang, lang, "en", "zz", None]), (host or "").rsplit(".", 1)[-1], ".".join((host or "").split(".")[-2:]), host))
    frame = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, domain string, host string").repartition(3)
    seen = {r["id"]: r for r in language_id.evidence(frame, languages).collect()}
    names = [*languages.languages, "und"]
    soft = {k: np.asarray(r["soft"]) for k, r in seen.items()}
    total = sum(soft.values())
    same = lambda c, row: sum(soft[r[0]] for r in rows if (r[c] or "") == (row[c] or ""))
    for r in language_id.identify(frame, languages).collect():
        row = rows[r["id"]]
        everywhere = (total + 1) / (total.sum() + 4)
        domain = np.maximum(0, same(4, row) - soft[r["id"]]) + 10 * everywhere
        host = np.maximum(0, same(5, row) - soft[r["id"]]) + 5 * domain / domain.sum()
        agree = np.asarray([0.8 if row[2] == n else 0.2 / 3 for n in names]) if row[2] in names else np.full(4, 0.25)
        declared = np.log((same(2, row) + 20 * agree) / (total + 20)) if row[2] else 0
        suffix = np.log((same(3, row) + 20 * same(3, row).sum() / total.sum()) / (total + 20))
        value = np.exp(np.asarray(seen[r["id"]]["log"]) + np.log(host / host.sum()) + declared + suffix)
        assert r["language"] == names[int(value.argmax())] and r["confidence"] == pytest.approx(value.max() / value.sum(), abs=1e-9)
        assert r["accepted"] == bool(r["language"] != "und" and r["confidence"] >= 0.5 and row[1])


def test_language_of_a_very_long_text(spark, languages):
    docs = spark.createDataFrame([(1, SAMPLES["de"] * 60_000, None, "h")], "doc_id long, text string, lang string, source string")
    assert [(r["language"], r["accepted"]) for r in language_id.identify(language_id.document_rows(docs), languages).collect()] == [("de", True)]


# --- quality


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def texts():
    draw = random.Random(3)
    rows = []
    for k in range(60):
        text = "".join(draw.choices(["the ", "of ", "wörd ", "a ", "\n", "x#y ", "\t", "日本 ", "end.\n", "|", "\x1f", " "], k=draw.randint(0, 300)))
        rows.append((k, text, draw.choice(["en", "fr", None, "xx"])))
    rows += [(100, None, "en"), (101, "", "de"), (102, "same line\nsame line\n\nsame line ", "en"), (None, "no id " * 60, "en"), (103, "w " * 5000 + "ä" * 3000, "en"), (0, rows[0][1], rows[0][2])]
    return rows


def test_quality_rules_count_exactly(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, n_words int").repartition(3)
    found = quality_rules.quality_rules(docs).collect()
    ours = sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in found)
    assert ours == sorted(repr((d, *base_counts(t))) for d, t, _ in rows)
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert quality_rules.quality_rules(docs.filter("false")).collect() == []


def prose(draw, n):
    common = quality_rules.COMMON_WORDS["en"]
    return " ".join(draw.choice(common) if draw.random() < 0.4 else "".join(draw.choices("aeionrstl", k=draw.randint(3, 9))) for _ in range(n))


def test_divergence_drops_junk_alone(spark):
    draw = random.Random(9)
    good = [(k, prose(draw, draw.randint(60, 400)), "en") for k in range(80)]
    bad = [(200 + k, re.sub(r"(\w+)", r"\1%%#", prose(draw, 200)), "en") for k in range(5)] + [(300 + k, prose(draw, 200).upper() + "!!", "en") for k in range(5)]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert not kept & {d for d, _, _ in bad} and len(kept) >= 78


def test_verdict_does_not_depend_on_how_rows_are_dealt(spark):
    draw = random.Random(10)
    rows = [(k, prose(draw, draw.randint(40, 200)), draw.choice(["en", "en", "xx", "rare", None])) for k in range(150)] + [(k, "x # y " * 40, "xx") for k in range(900, 910)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").persist()
    told = [sorted(map(repr, quality_rules.quality_rules(docs.repartition(n), min_documents=20).collect())) for n in (1, 9)]
    assert told[0] == told[1]
    assert "all others" in told[0][0] + told[0][-1] + "".join(told[0])


def test_rules_against_their_sql(spark):
    import duckdb

    draw = random.Random(14)
    rows = [(k, prose(draw, draw.randint(40, 300)) + draw.choice(["", "\nEnd.", "\n\nEnd.\nEnd."]), draw.choice(["en", "de", None])) for k in range(200)] + texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    con = duckdb.connect()
    con.register("docs", docs.toPandas())
    columns = ["doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kinds_distance", "words_distance", "kept"]
    ours = [tuple(r) for r in quality_rules.quality_rules(docs).select(*columns).collect()]
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({quality_rules.oracle('docs')})").fetchall()
    assert len({r[-1] for r in ours}) == 2
    key = lambda rows: sorted(repr(tuple(None if x != x else x for x in r)) for r in rows)
    assert key(ours) == key((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in theirs)


def test_jensen_shannon(spark):
    row = spark.range(1).select(quality_rules.jensen_shannon(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality_rules.jensen_shannon(F.array(F.lit(0.25), F.lit(0.75)), F.array(F.lit(0.25), F.lit(0.75))).alias("same")).first()
    assert (row["far"], row["same"]) == (pytest.approx(1), pytest.approx(0))


@pytest.mark.parametrize("work", [quality_classifier.text_features, lambda column: language_id.likelihoods(column, np.ones((4, language_id.BUCKETS)))[0]])
def test_work_on_many_texts_takes_little_memory(work):
    draw = random.Random(3)
    words = SAMPLES["de"].split() + ["|", "3", "WORD!", "\n"]
    texts = ["", *(" ".join(draw.choices(words, k=draw.randrange(700))) for _ in range(1000)), " ".join(words * 3000)]
    column = pa.array(texts)
    work(column)  # what is kept for later calls
    tracemalloc.start()
    found = work(column[:-1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1001 and most < 12 * column[:-1].nbytes
    assert work(column).tolist() == [work(column[k : k + 1])[0].tolist() for k in range(len(column))]
    assert len(work(column[:0])) == 0
    assert work(pa.array(["", "a"])).dtype == float


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    draw = random.Random(2)
    rows = [(k, prose(draw, 120) if k % 3 else re.sub(" ", " ## ", prose(draw, 60)), "p") for k in range(400)]
    docs = spark.createDataFrame([*rows, (None, "x", "q"), (401, None, "q"), (402, "", "q")], "doc_id long, text string, label string")
    labels = [(k, int(k % 3 > 0)) for k in range(400)]
    told = spark.createDataFrame([*labels, (None, 1), (401, None), (7, 7)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_classifier.quality_classifier(docs, told).collect()}
    assert len(found) == 403 and all(0 <= r["score"] <= 1 for r in found.values())
    held = [k for k in range(400) if found[k]["held_out"]]
    assert held and np.mean([found[k]["predicted"] == int(k % 3 > 0) for k in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    # other labels of held-out rows change nothing
    flipped = spark.createDataFrame([(k, 1 - q if found[k]["held_out"] else q) for k, q in labels], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in quality_classifier.quality_classifier(docs, flipped).collect()}
    assert all(again[k] == pytest.approx(found[k]["score"], abs=1e-9) for k in again)


def test_classifier_takes_each_labelled_id_once(spark):
    draw = random.Random(21)
    rows = [(k, prose(draw, 80) if k % 2 else "## " + prose(draw, 40).replace(" ", " # ")) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    hot = [(1, prose(draw, 80)) for _ in range(300)]
    model = lambda rs: quality_classifier.fit_whole(spark.createDataFrame(rs, "doc_id long, text string").repartition(5), labels, max_labelled=60)[0]
    first, again = model(rows + hot), model(hot[::-1] + rows[::-1])
    assert np.array_equal(first.weights, again.weights) and first.quantile == again.quantile
    # the quantile parts the labels of rows beyond those that were learned from
    found = quality_classifier.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_labelled=60).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in found]) > 0.97
    long = spark.createDataFrame([*rows, (500, rows[1][1] * 5000), (500, rows[1][1] * 5000)], "doc_id long, text string")
    found = quality_classifier.quality_classifier(long, labels).filter("doc_id = 500").collect()
    assert len(found) == 2 and found[0] == found[1] and 0 <= found[0]["score"] <= 1


def test_weights_minimise_the_pairwise_loss():
    draw = np.random.default_rng(2)
    x, good = draw.normal(size=(300, 4)), draw.random(300) < 0.6
    x[good, 1] += 1
    model = quality_classifier.fit_pairs(x, good, pairs=20_000)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    again = np.random.default_rng(7)
    d = z[again.choice(np.flatnonzero(good), 20_000)] - z[again.choice(np.flatnonzero(~good), 20_000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.5e-3 * w @ w
    assert all(loss(model.weights) < loss(model.weights + 0.01 * step) for step in draw.normal(size=(40, 4)))


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in quality_classifier.quality_classifier(docs, none).collect()} == {(0.5, 0)}
    model = quality_classifier.fit(docs, none)
    assert quality_classifier.accepted(docs, model).count() == 2
    assert quality_classifier.quality_classifier(docs.filter("false"), none).collect() == []


def test_pairs_prefer_better_rows():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(500, 3))
    good = x[:, 0] + 0.1 * draw.normal(size=500) > -0.5
    model = quality_classifier.fit_pairs(x, good, float((~good).mean()))
    assert ((model.score(x) >= 0.7) == good).mean() > 0.95 and model.weights[0] > 5 * abs(model.weights[1:]).max()
