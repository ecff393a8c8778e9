"""Pipeline stages against brute force on their own input, and odd rows through all of them."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from phonolake.llm.cube import mix_sources
from phonolake.llm.recompression import without_repeats
from phonolake.llm.toxicity import score_toxicity
from phonolake.llm.text import public_id
from tests.llm.test_recompression import brute as brute_repeats
from tests.llm.test_simhash import brute as brute_components
from tests.llm.test_spaced_seeds import brute as brute_leaks
from tests.llm.test_toxicity import rows_and_labels

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    texts, labels = rows_and_labels(500)
    rows = [(d, t, "en", f"s{d % 4}", len(t)) for d, t, _ in texts]
    rows += [(1000 + k, rows[k][1] + (" extra" if k % 2 else ""), "en", "s1", 0) for k in range(40)]
    item = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(30))
    long = " ".join(f"p{k}" for k in range(70))
    rows += [(2000, f"{texts[0][1]} {item} tail", "en", "s2", 0), (2001, item.upper(), "en", "s2", 0)]
    rows += [(2010 + k, f"start{k}\n\n{' '.join(f'a{k}b{j}' for j in range(80))} {long}\nend{k} ", "en", "s3", 0) for k in range(4)]
    rows += [(None, None, None, None, None), (None, "", "en", "s0", 0), (3000, None, "en", None, None), (3001, "dup row", "x", "s0", 7), (3001, "dup row", "x", "s0", 7)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(df):
    key = lambda r: tuple((x is None, x or 0) for x in r[:2])
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in scores.filter("predicted = 1").select(public_id()).collect()}
    rows = plain(docs)
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.schema == docs.schema
    assert plain(kept) == [r for r in rows if r[0] not in bad or r[0] is None]

    rows = plain(kept)
    components = brute_components([r[:2] for r in rows])
    single = corpus_pipeline.drop_near_duplicates(spark, kept, folder)
    assert single.schema == docs.schema
    got = plain(single)
    assert len(got) == len({(c[2] if c[2] is not None else c[1]) for c in components})
    assert {r[0] for r in got} == {c[2] for c in components}

    rows = got
    cut = corpus_pipeline.drop_repeats(spark, single, folder)
    assert cut.schema == docs.schema
    want = {d: k for d, _, n, k in brute_repeats([r[:2] for r in rows], 50)}
    got = plain(cut)
    assert all((r[1] or "").split() == want[r[0]].split() for r in got) and len(got) == len(rows)
    before = {r[0]: r for r in rows}
    assert all(r[1] == before[r[0]][1] for r in got if (r[1] or "").split() == (before[r[0]][1] or "").split())
    assert sum((r[1] or "") != (before[r[0]][1] or "") for r in got) >= 3

    rows = got
    clean = corpus_pipeline.drop_leaks(spark, cut, folder)
    leaked = {d for d, *_ in brute_leaks([r[:2] for r in rows], [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])}
    assert clean.schema == docs.schema and leaked
    assert plain(clean) == [r for r in rows if r[0] not in leaked]

    mixed = corpus_pipeline.mix(spark, clean, folder)
    taken = {r.doc_id: r.repeats for r in mix_sources(clean).select(public_id(), "repeats").collect() if r.repeats}
    seen = {}
    for r in mixed.collect():
        seen.setdefault(r.doc_id, []).append(r.copy)
    assert {d: len(c) for d, c in seen.items()} == taken and all(sorted(c) == list(range(1, len(c) + 1)) for c in seen.values())


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == [c.split()[0] for c in COLUMNS.split(", ")]
    rows = out.collect()
    assert rows and sum("zorgle" in (r.text or "") for r in rows) < 0.05 * len(rows)


def test_clashing_column_names(spark):
    odd = "doc_id long, text string, row int, starts int, `a.b` int, doc int, tag int"
    df = spark.createDataFrame([(1, "x " * 60, 1, 2, 3, 4, 5), (2, "x " * 61, 1, 2, 3, 4, 5), (3, None, None, None, None, None, None)], odd)
    got = {r.doc_id: r for r in without_repeats(df).collect()}
    assert got[1].text == "x " * 60 and got[2].text == "" and got[3].text is None and got[2]["a.b"] == 3 and got[2].tag == 5
