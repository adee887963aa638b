"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import zlib

import pytest

from tessera.llm import packing, toxicity

from .fixtures import corpus, frame, prose
from .test_pairs import brute_lines, brute_near
from .test_scans import brute_contained, brute_pack, brute_scores

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    rows = corpus(seed=9)
    items = [(i, prose(rng, 40)) for i in range(4)]
    rows += [(5000 + i, prose(rng, 60) + " " + t) for i, t in items]
    rows += [(5500 + i, prose(rng, 50)) for i in range(200)]
    rows += [(6000 + i, prose(rng, 40) + " vlorg vlorgish skreeb " + prose(rng, 5)) for i in range(120)]
    labels = [(6000 + i, 1, 1) for i in range(80)] + [(d, 1, 0) for d, _ in rows if d < 5700]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert 4 <= len(pipeline.STAGES) <= 5
    for name, stage in pipeline.STAGES[:-1]:
        before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            clean = [d for d, _ in before if d < 6000]
            marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
            learn = sorted((d, t, marks[d]) for d, t in before if d in marks and t is not None and len(t) <= toxicity.Settings().longest)
            scores = brute_scores(toxicity.train([t for _, t, _ in learn], [y for _, _, y in learn]), before)
            assert all((d in after) == (x < 0.7) for d, x in scores.items() if abs(x - 0.7) > 1e-4)
            assert len([d for d in after if d >= 6000]) <= 12 and len([d for d in after if d < 6000]) >= 0.97 * len(clean)
        elif name == "line dedup":
            gone = {d: g for d, _, g in brute_lines(before)}
            for d, t in before:
                assert after[d].text == (t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]))
                assert t is None or after[d].n_chars == len(after[d].text)
        elif name == "near dedup":
            assert sorted(after) == sorted(r[0] for r in brute_near(before, k=5, percent=80) if r[3])
        else:
            assert sorted(after) == [d for d, hits in brute_contained(before, items) if not hits]
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    last = pipeline.STAGES[-1][1](spark, docs, folder)
    rows = last.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    bins, want = {}, {}
    for r in rows:
        bins.setdefault((r.bin_id, r.capacity), []).append(r.n_tokens)
    lengths = packing.Lengths()
    sizes = [n for r in docs.collect() for n in pieces_of(len((r.text or "").split()) + 1, max(lengths.permitted))]
    for n, b in zip(sizes, brute_pack(sizes, lengths), strict=True):
        want.setdefault(b, []).append(n)
    full = [(min(c for c in lengths.permitted if c >= sum(x)), sorted(x)) for x in want.values()]
    assert sorted((c, sorted(x)) for (_, c), x in bins.items()) == sorted(full)


def pieces_of(n, most):
    """A length cut into pieces of the largest permitted one and a rest."""
    return [most] * ((n - 1) // most) + [n - (n - 1) // most * most]


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 50


def test_empty_documents(spark, folder):
    docs = frame(spark, [], False).limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def test_decisions_reach_rows_of_null_and_repeated_ids(spark, folder):
    rng = random.Random(4)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    one, two, three = (prose(rng, 60) for _ in range(3))
    leak = prose(rng, 30) + " " + item
    rows = [(1, one), (None, one), (2, two), (2, three), (3, three), (4, one + " more"), (5, leak), (5, prose(rng, 50)), (None, leak + " x"), (None, None), (None, ""), (6, "same row twice over"), (6, "same row twice over")]
    docs = frame(spark, rows, False)
    near = sorted(((r.doc_id, r.text) for r in dict(pipeline.STAGES)["near dedup"](spark, docs, folder).collect()), key=str)
    assert near == sorted([r for i, r in enumerate(rows) if i not in (1, 4, 5, 8, 12)], key=str)
    clean = sorted(((r.doc_id, r.text) for r in dict(pipeline.STAGES)["decontamination"](spark, docs, folder).collect()), key=str)
    assert clean == sorted([r for i, r in enumerate(rows) if i not in (6, 8)], key=str)
