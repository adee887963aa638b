"""Resampling, quality rules and phrases against brute force."""

import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, quality, resample
from tessera.llm._words import chunks

from .fixtures import corpus, frame, prose


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- resampling ---------------------------------------------------------------


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute_resample(docs, target, percent=25, least=20, salt="7", buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = counts(x for _, x in docs), counts(target)
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    out, able = [], []
    for d, text in docs:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{salt}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None])
        if len(w) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def drawn(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_crc_of_words_and_pairs():
    import pyarrow as pa

    texts = ["Ab c-d é_9", None, "", "x" * 300 + " y " + "z" * 70, "one"]
    for w in chunks(pa.array(texts), resample.NOT_WORD, lower=True):
        one, two, _ = resample._features(w)
        want = [features(t) for t in texts]
        assert one.tolist() == [zlib.crc32(x.encode()) for words, _ in want for x in words]
        assert two.tolist() == [zlib.crc32(x.encode()) for words, f in want for x in f[len(words) :]]


@pytest.mark.parametrize("percent", [25, 60, 100, 0])
def test_resampling_equals_brute_force(spark, percent):
    docs = corpus(seed=9)
    target = [docs[5][1], "Ra12 to3 \x00 nun5", None]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance_resample(frame(spark, docs), goal, percent=percent)
    assert drawn(got) == brute_resample(docs, target, percent)


def test_resampling_of_ties_null_ids_and_empty_tables(spark):
    rng = random.Random(3)
    text = prose(rng, 30)
    docs = [(None, text), (None, text), (4, text), (4, text), (4, text), (5, None), (6, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = drawn(resample.importance_resample(df, none, percent=60))
    assert [r[:4] for r in got] == [r[:4] for r in brute_resample(docs, [], 60)]
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3]
    assert drawn(resample.importance_resample(df.limit(0), none)) == []
    named = df.select(F.concat(F.lit("k"), F.coalesce("doc_id", F.lit(0))).alias("doc_id"), "text")
    assert len(drawn(resample.importance_resample(named, none))) == 7


def test_offsets_count_all_higher_scores(spark):
    rng = random.Random(7)
    scores = [rng.randrange(-3000, 3000) // rng.choice((1, 500)) for _ in range(700)]
    got = {r.score: (r.n, r.above) for r in resample.score_offsets(spark.createDataFrame([(s,) for s in scores], "score long")).collect()}
    assert got == {s: (scores.count(s), sum(x > s for x in scores)) for s in set(scores)}


# --- quality ------------------------------------------------------------------

SPACE = "[\\x20\\x09-\\x0D]"


def brute_measures(text):
    text = text or ""
    w = re.findall("[^\\x20\\x09-\\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


JUNK = [
    ("symbols", "a word### and more " * 20 + "x y z"),
    ("caps", " ".join(f"WORD{i}" for i in range(80))),
    ("shout", " ".join(f"w{i}!" for i in range(80))),
    ("lines", "\n".join(["same line"] * 15 + [f"a{i} b{i} c{i} d{i} e{i}" for i in range(12)])),
    ("open", "\n".join(f"a{i} b{i} c{i} d{i}..." for i in range(20))),
    ("digits", " ".join(str(i) for i in range(90))),
    ("long", " ".join(f"{i}" + "x" * 20 for i in range(60))),
]


def texts():
    rng = random.Random(12)
    docs = corpus(seed=2) + [(5000 + i, t) for i, (_, t) in enumerate(JUNK)]
    for n in (2, 3, 4, 60):
        docs += [(6000 + n, " ".join(["x"] * n)), (6100 + n, " ".join(rng.choice("abc") for _ in range(n)))]
    return docs + [(7000, " ".join(rng.choice("ab") + str(rng.randrange(40)) for _ in range(70_000)))]


def test_measures_and_verdicts_equal_brute_force(spark):
    docs = texts()
    plain = spark.createDataFrame([(d, t, 9, "x") for d, t in docs], "doc_id long, text string, n_words int, kept string").repartition(3)
    by_id = {d: t for d, t in docs}
    out = quality.judge_quality(plain).collect()
    assert len(out) == len(docs)
    for r in out:
        m = brute_measures(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, r.doc_id
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in out}
    assert [name for i, (name, _) in enumerate(JUNK) if kept[5000 + i]] == []
    clean = [d for d, t in docs if d < 5000 and len((t or "").split()) >= 60 and brute_measures(t)[4] == 0]
    assert clean and all(kept[d] for d in clean)


def test_rules_are_ordered_by_rejection_per_cost_and_order_keeps_the_verdict(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    ordered = quality.plan(docs, quality.RULES)
    assert sorted(r.name for r, _, _ in ordered) == sorted(r.name for r in quality.RULES)
    rate = [gone / cost for _, cost, gone in ordered]
    assert all(gone == 0 for _, _, gone in ordered[next((i for i, x in enumerate(rate) if x == 0), len(rate)) :])
    verdicts = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        rows = quality.measured(docs).select("doc_id", quality.cascade([*quality.BASE, *rules]).isNull().alias("kept"))
        verdicts.append(sorted((r.doc_id, r.kept) for r in rows.collect()))
    assert verdicts[0] == verdicts[1] == sorted((r.doc_id, r.kept) for r in quality.judge_quality(docs).collect())


def test_a_later_rule_is_not_evaluated_for_rejected_texts(spark):
    fails = quality.Rule("breaks", lambda: F.raise_error(F.lit("asked")).isNull())
    rows = spark.range(3).select(F.lit("a b").alias("__text"), F.lit(2).alias("n_words"))
    named = rows.select(quality.cascade([quality.Rule("short", lambda: F.col("n_words") < 50), fails]).alias("r")).collect()
    assert [r.r for r in named] == ["short"] * 3


def test_quality_of_empty_tables_and_no_rules(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge_quality(none).collect() == []
    some = spark.createDataFrame([(1, "a b c " * 40), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in quality.judge_quality(some, rules=[], base=[]).collect()) == [(1, True), (2, True)]


# --- phrases ------------------------------------------------------------------


def brute_phrases(docs, least, top=2_000, percent=50):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    rows = {}
    for (lang, w), a in found.items():
        if any(len(v) > len(w) and o == lang and 100 * b >= percent * a and w in (v[:2], v[1:]) for (o, v), b in found.items()):
            continue
        cuts = [(math.floor(Fraction(10**6 * a * a, f[lang, w[:k]] * f[lang, w[k:]])), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, k, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, of in rows.items() for k, x in enumerate(sorted(of)[:top], 1)
    )


def phrase_docs(seed=1):
    rng = random.Random(seed)
    words = ["The", "new", "york", "of", "a", "Ünder", "x" * 300, "\x1cq", "it", "été"]
    docs = [(rng.choice(("en", "de", None, "")), " ".join(rng.choice(words) + rng.choice(("", "", "", ".", ", b", "\n", "\t-")) for _ in range(rng.randrange(0, 60)))) for _ in range(120)]
    return docs + [(None, None), ("en", ""), ("en", "new york city " * 30), ("fr", "a b " * 50), ("fr", "seul"), ("und", "new york")]


def mined(df, **args):
    return sorted(tuple(r) for r in collocations.collocations(df, **args).collect())


def test_slabs_let_their_parts_go_and_need_no_strings():
    texts = [f"one two, three{i} four." for i in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts)), pa.array(np.full(len(texts), 7))], ["text", "lang", "mark"])
    full = list(collocations._slabs(iter([batch]), 0))
    lean = collocations._slabs(iter([batch]), 0, strings=False)
    slab = next(lean)
    gc.collect()
    alive = [x for x in gc.get_objects() if isinstance(x, collocations.Slab)]
    assert len(full) == 1 and len(alive) == 2  # the full one and the lean one, none of their parts
    assert np.array_equal(slab.h, full[0].h) and np.array_equal(slab.linked, full[0].linked)
    assert not len(slab.data) and not len(slab.start) and not slab.langs
    assert next(lean, None) is None


@pytest.mark.parametrize("spread", [False, True])
def test_phrases_equal_brute_force_also_with_spread_prefixes(spark, monkeypatch, spread):
    if spread:  # many tasks, and prefixes that are dealt by their third word too
        monkeypatch.setattr(collocations, "TASK_POINTERS", 20)
    docs = phrase_docs()
    df = spark.createDataFrame([(lang, t, 1, "z") for lang, t in docs], "lang string, text string, n int, a string").repartition(5)
    assert mined(df, least=4, top=12) == brute_phrases(docs, 4, 12)
    assert mined(df, least=10) == brute_phrases(docs, 10)


def test_blocks_of_a_reading_task_may_end_within_a_phrase(spark, monkeypatch):
    docs = phrase_docs(2)
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    texts_ = collocations._texts(df, "text", "lang", "und")
    every = np.full(collocations.FILTER_BITS >> 6, 2**64 - 1, np.uint64)
    none = np.zeros_like(every)
    grown = {}
    for block in (7, 1 << 20):
        monkeypatch.setattr(collocations, "BLOCK", block)
        rows = collocations.grow(collocations.pointers(texts_, 0, every, none, 3), 5, none).collect()
        grown[block] = sorted(map(tuple, rows))
    assert grown[7] == grown[1 << 20] and grown[7]


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**13, 10**13, 10**13), (3 * 10**9 + 1, 7 * 10**9, 3 * 10**9 + 7), (10, 2**40, 2**41)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r.s for r in df.select(collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in cases]


def test_words_that_share_a_hash_get_another_hash(spark, monkeypatch):
    real, seen = collocations.vocabulary, []

    def clashing(texts, salt):
        seen.append(salt)
        rows = real(texts, salt)
        return rows.withColumn("h", F.lit(1).cast("long")) if salt == 0 else rows

    monkeypatch.setattr(collocations, "vocabulary", clashing)
    docs = phrase_docs(3)
    assert mined(spark.createDataFrame(docs, "lang string, text string"), least=6) == brute_phrases(docs, 6)
    assert seen == [0, 1]


def test_no_phrases_in_empty_tables(spark):
    assert mined(spark.createDataFrame([], "lang string, text string")) == []
    assert mined(spark.createDataFrame([("en", "only once here")], "lang string, text string")) == []
