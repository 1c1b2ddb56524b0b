"""The pipeline's run against brute force, stage by stage on whole texts, and on odd rows."""

import hashlib
import re
import shutil

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_group_join import brute as brute_components
from tests.llm.test_native import brute_contamination, brute_mix
from tests.llm.test_token_orc import brute as brute_tokens
from tuneforge.llm import mixing, quality_forest, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_mixed(rows, share, seed):
    """doc_ids of a one-epoch mix; rows: (doc_id, text, lang, source) with ids of their own."""
    known = []
    for d, text, lang, source in rows:
        number = re.search("[0-9]+$", source)
        known.append((f"domain{int(number[0]) % mixing.DOMAINS}", lang, source, d, len(WORD.findall(text))))
    supply, alloc = brute_mix(known, share, 1, seed)
    out = {}
    for leaf, budget in alloc.items():
        own = [(d, t) for *path, d, t in known if tuple(path) == leaf and t]
        whole, taken, ids = budget >= supply[leaf] - 1e-9, 0, []
        for d, t in sorted(own, key=lambda x: (hashlib.md5(f"{seed}:1:{x[0]}".encode()).hexdigest(), x[0])):
            if whole or taken < budget:
                ids.append(d)
            taken += t
        out[leaf] = ids
    return out


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    labels, items = queries.table(spark, SF_SMALL, "labels"), [(r["item_id"], r["text"]) for r in queries.table(spark, SF_SMALL, "benchmark").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in quality_forest.quality_verdicts(docs, labels).collect()}
    left = [d for d in rows if verdicts[d]]
    assert 0 < len(left) < len(rows)
    found = brute_components([(d, rows[d]["text"]) for d in left])
    left = [d for d in left if found[d][1] == d]
    clean = [d for d in left if not brute_contamination(rows[d]["text"], items)[1]]
    assert len(clean) < len(left)
    named = [(d, rows[d]["text"], rows[d]["lang"], rows[d]["source"]) for d in clean]
    mixed = sorted(d for ids in brute_mixed(named, corpus_pipeline.MIX_SHARE, corpus_pipeline.MIX_SEED).values() for d in ids)

    got = docs
    want = [sorted(d for d in rows if verdicts[d]), sorted(left), sorted(clean), mixed]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        got = stage(spark, got, SF_SMALL)
        assert got.columns == docs.columns, name
        assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == ids, name
    out = [tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).orderBy("start").collect()]
    assert out == brute_tokens([(d, rows[d]["text"]) for d in mixed])


def test_stages_on_odd_rows_and_an_empty_table(spark, odd_docs, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    for docs in (odd_docs, odd_docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count(), name
            if name != "tokens":
                assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
