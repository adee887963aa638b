"""Substring, line, exact and near deduplication against brute force, with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from tessera.llm import _words, line_dedup, near_dedup, substring_dedup
from tessera.llm.exact_dedup import exact_dedup

from .fixtures import corpus, frame, prose

SPACE = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def brute_windows(rows, w=35):
    seen = defaultdict(int)
    for _, t in rows:
        ws = words_of(t)
        for i in range(len(ws) - w + 1):
            seen[tuple(ws[i : i + w])] += 1
    out = []
    for d, t in rows:
        ws = words_of(t)
        gone = set()
        for i in range(len(ws) - w + 1):
            if seen[tuple(ws[i : i + w])] > 1:
                gone.update(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    rows = corpus() + [(1, corpus()[0][1]), (5000, "a b " * 40)]
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_windows(rows)
    assert any(r[2] for r in got)


def thue_morse(bits):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_words_that_polynomials_confuse_differ(spark, bits):
    one = thue_morse(bits)
    two = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(34))
    got = substring_dedup.substring_dedup(frame(spark, [(1, f"{same} {one}"), (2, f"{same} {two}")], False)).collect()
    assert [r.n_removed for r in got] == [0, 0]
    near = near_dedup.near_dedup(frame(spark, [(1, one), (2, two)], False)).collect()
    assert all(r.kept for r in near)


def test_hashes_of_words_follow_the_whole_word():
    text = " ".join(["a", "b", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 256, "a" * 257, "a" * 999, "a" * 998 + "b", "b" + "a" * 998, "é", "\x00", "\x00\x00"])
    words = next(_words.chunks(pa.array([text])))
    for which in (0, 1):
        assert len(set(words.hashes(which).tolist())) == 15
    again = next(_words.chunks(pa.array(["x " + text])))
    assert again.hashes()[1:].tolist() == words.hashes().tolist()


def test_index_finds_repeats_across_batches_and_compacts(spark):
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "fp long")
    assert [r.fp for r in index.ingest(batch(1, 2, 2, 3)).collect()] == [2]
    assert sorted(r.fp for r in index.ingest(batch(3, 4)).collect()) == [3]
    assert [len(level) for level in index.levels] == [0, 1]
    assert sorted(r.fp for r in index.ingest(batch(4, 5, 1)).collect()) == [1, 4]
    assert sorted(r.fp for r in index.repeated().collect()) == [1, 2, 3, 4]


def test_further_batches_are_held_against_a_stored_index(spark, tmp_path):
    rows = corpus(seed=12)
    folder, seen = str(tmp_path / "index"), []
    for k in range(3):
        batch = rows[k::3]
        seen += batch
        index = substring_dedup.FingerprintIndex.open(spark, folder) if k else substring_dedup.FingerprintIndex(spark, folder)
        got = substring_dedup.substring_dedup(frame(spark, batch), index=index).collect()
        ids = {d for d, _ in batch}
        assert sorted(map(tuple, got)) == [r for r in brute_windows(seen) if r[0] in ids]
    assert sum(r.n_removed for r in got) > sum(r[2] for r in brute_windows(batch))
    again = substring_dedup.FingerprintIndex.open(spark, folder)
    assert again.version == 3 and [len(level) for level in again.levels] == [1, 1] and len(again.batches) == 3


def test_only_texts_that_share_a_fingerprint_are_opened_again(spark, tmp_path):
    rng = random.Random(3)
    first = [(i, prose(rng, 60)) for i in range(40)]
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
    substring_dedup.substring_dedup(frame(spark, first), index=index).collect()
    known = spark.read.parquet(f"{index.folder}/{index.batches[0]}-places")
    some = known.orderBy("fp").limit(3)
    found = index.documents(index.batches, some.select("fp")).collect()
    assert {(r.k1, r.k2) for r in found} == {(r.k1, r.k2) for r in some.collect()}
    got = substring_dedup.substring_dedup(frame(spark, [(100, first[7][1]), (101, prose(rng, 50))]), index=index).collect()
    assert {r.doc_id: r.n_removed for r in got} == {100: 60, 101: 0}


def test_an_index_without_its_documents_and_a_second_writer_are_refused(spark, tmp_path):
    rows = frame(spark, corpus(seed=12)[:20])
    loose = substring_dedup.FingerprintIndex(spark)
    substring_dedup.substring_dedup(rows, index=loose)
    with pytest.raises(ValueError, match="documents"):
        substring_dedup.substring_dedup(rows, index=loose)
    assert len(substring_dedup.substring_dedup(rows, index=loose, history=rows).collect()) == 20
    folder = str(tmp_path / "index")
    substring_dedup.substring_dedup(rows, index=substring_dedup.FingerprintIndex(spark, folder))
    one, two = (substring_dedup.FingerprintIndex.open(spark, folder) for _ in range(2))
    substring_dedup.substring_dedup(rows, index=one)
    with pytest.raises(RuntimeError, match="another writer"):
        substring_dedup.substring_dedup(rows, index=two)
    assert substring_dedup.FingerprintIndex.open(spark, folder).batches == one.batches


def test_exact_dedup(spark):
    rows = corpus() + [(1, "twice"), (1, "twice"), (None, "twice"), (2, "a\tb"), (9, "a  b"), (8, " a b")]
    got = sorted(map(tuple, exact_dedup(frame(spark, rows), bits=1).collect()), key=str)
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(SPACE, " ", t or "")].append(d)
    for d, keep, size, kept, sha in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
        ids = groups[text]
        assert d in ids and size == len(ids) and keep == min(x for x in ids if x is not None)
    assert len(got) == len(rows)
    assert sum(r[3] for r in got) == len(groups)
    assert sum(r[3] for r in got if r[0] == 1 and r[2] == 3) == 1


def brute_near(rows, k=3, percent=85):
    sets = []
    for d, t in rows:
        ws = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
        sets.append((d, s))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)] if s else d, d == (least[find(i)] if s else d)) for i, (d, s) in enumerate(sets))


def test_near_dedup(spark):
    rows = corpus(seed=8)
    got = sorted(map(tuple, near_dedup.near_dedup(frame(spark, rows)).collect()))
    assert got == brute_near(rows)
    assert any(not r[3] for r in got)


def test_near_dedup_links_chains_of_variants(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for v in range(40):
        rows.append((1000 - v, " ".join(base[v:] + [f"v{v}x{i}" for i in range(v)])))
    got = sorted(map(tuple, near_dedup.near_dedup(frame(spark, rows, False)).collect()))
    assert got == brute_near(rows)


def brute_lines(rows, percent=80):
    lines = []
    for d, t in rows:
        for i, raw in enumerate(t.split("\n") if t is not None else []):
            lines.append((d, i, frozenset(words_of(raw))))
    gone = defaultdict(list)
    lines.sort(key=lambda x: x[:2])
    for x, (d, i, a) in enumerate(lines):
        for _, _, b in lines[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                gone[d].append(i)
                break
    return sorted((d, len(t.split("\n")), sorted(gone[d])) for d, t in rows if t is not None)


prose_ = "some longer line of words which only one number at its end sets apart"


@pytest.mark.parametrize(("common", "held"), [(2, 0), (3, 1000), (512, 1000)])
def test_line_dedup(spark, common, held):
    rows = corpus(seed=5) + [(4000 + i, f"Read more\n{w} {w}\n- \n\nRead  more {w}\n{prose_} {i}") for i, w in enumerate(("a", "b", "a", "c"))]
    docs = frame(spark, rows)
    found = line_dedup.removed_lines(docs, settings=line_dedup.Settings(common=common, held=held, hot=3, cells=64, filter_bits=1 << 10))
    got = sorted((r.doc_id, r.n_lines, list(r.removed)) for r in found.collect())
    assert got == brute_lines(rows)
    left = line_dedup.without_lines(docs, found)
    assert left.columns == docs.columns
    text = {r.doc_id: r.text for r in left.collect()}
    for d, t in rows:
        drop = next((g[2] for g in got if g[0] == d), [])
        assert text[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))


@pytest.mark.parametrize("run", [substring_dedup.substring_dedup, exact_dedup, near_dedup.near_dedup, line_dedup.removed_lines])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_only_nulls_and_empty(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, None), (3, " ")])
    assert sorted(r[1:3] for r in substring_dedup.substring_dedup(docs).collect()) == [(0, 0)] * 4
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()} == {1: 1, 2: 2, 3: 3, None: None}
    assert {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(docs).collect()} == {2: [], 3: []}
