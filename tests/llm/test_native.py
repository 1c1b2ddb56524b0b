"""Decontamination, license spans and mixing: brute force, odd rows, and no Python in the plans."""

import hashlib
import re

import pytest

from tuneforge.llm import decontaminate, license, mixing, queries
from tests.conftest import SF_SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items, k=10):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        for i in range(max(len(v) - k, 0) + 1 if v else 0):
            gram = v[i : i + k]
            for p in range(len(w) - len(gram) + 1):
                if w[p : p + len(gram)] == gram:
                    hit.update(range(p, p + len(gram)))
                    found.add(item_id)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


ITEMS = [(1, "one Two THREE four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, ""), (None, "nameless thing here"), (2, "short item"), (5, "x y x y x y x y x y x y")]


def test_contamination_against_brute_force(spark, make_docs, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [
        "zero one two three, four FIVE six seven eight nine ten eleven twelve end", "a short-item! short item", "one two three four five six seven eight nine",
        "x y " * 30, "nameless thing here", "É short item ÀB", "item", "short", "y x short item x y short item",
    ]
    docs = make_docs([(100 + k, t) for k, t in enumerate(texts)]).union(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = decontaminate.find_contamination(docs, items).collect()
    want = sorted([(r["doc_id"] or -1, *brute_contamination(r["text"], ITEMS)) for r in docs.collect()], key=repr)
    assert sorted([(r["doc_id"] or -1, r["n_words"], r["n_hit"], sorted(map(str, r["items"]))) for r in rows], key=repr) == want
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns
    assert left.count() == sum(w[2] == 0 for w in want)


def test_contamination_of_empty_tables(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_contamination(make_docs([]), items).collect() == []
    docs = make_docs([(1, "short item"), (2, None)])
    for none in (items.where("false"), items.where("item_id in (3, 4)")):
        assert [(r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, none).collect()] == [(0, [])] * 2
        assert decontaminate.decontaminated(docs, none).count() == 2


def test_license_spans(make_docs):
    mit = license.NOTICES[1][0]
    put_in = mit.replace("free of charge", "entirely free of all charge")
    texts = [
        "CC-BY and cc by cc by", "GNU General Public License", "all rights. Reserved all rights", mit.upper(), put_in, mit[: len(mit) // 3],
        "general public licenses", "", None, "Licensed under CC BY-NC 4.0.",
    ]
    got = {r["doc_id"]: r for r in license.license_report(make_docs(list(enumerate(texts)))).collect()}
    assert [(got[k]["n_base"], got[k]["base_labels"], got[k]["labels"]) for k in range(len(texts))] == [
        (3, "cc-by", "cc-by"), (1, "gpl", "gpl"), (1, "reserved", "reserved"), (0, "", "mit"), (0, "", "mit"), (0, "", ""),
        (0, "", ""), (0, "", ""), (0, "", ""), (1, "cc-by", "cc-by,cc-by-nc-4.0"),
    ]
    assert (got[0]["first_word"], got[0]["last_word"], got[1]["first_word"]) == (0, 5, 1)
    assert got[3]["score"] == 1 and 0.75 <= got[4]["score"] < 1 and got[7]["score"] == 0 and got[7]["first_word"] is None


def test_license_odd_rows(odd_docs, make_docs):
    rows = license.license_report(odd_docs).collect()
    assert sorted(r["n_words"] for r in rows) == sorted(len(words(r["text"])) for r in odd_docs.collect())
    assert license.license_report(make_docs([])).collect() == []


def water_fill(budget, children):
    """children: name -> (weight, cap), by repeated rounds in real numbers."""
    alloc, left, open_ = {}, budget, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if cap * total <= left * w]
        if not full:
            return alloc | {n: left * w / total for n, (w, _) in open_.items()}
        for n in full:
            alloc[n] = open_.pop(n)[1]
            left -= alloc[n]
    return alloc


def brute_mix(rows, share, max_epochs, seed):
    """rows: (domain, lang, source, doc_id, tokens). Allocations to within a token for each level."""
    leaves = {}
    for d, g, s, _, t in rows:
        leaves[d, g, s] = leaves.get((d, g, s), 0) + t
    budget = sum(leaves.values()) * share[0] // share[1]
    out = {}
    caps = lambda prefix: sum(v * max_epochs for k, v in leaves.items() if k[: len(prefix)] == prefix)
    top = water_fill(budget, {d: (mixing.DOMAIN_WEIGHTS.get(d, 1), caps((d,))) for d in {k[0] for k in leaves}})
    for d, b in top.items():
        langs = water_fill(b, {g: (mixing.LANG_WEIGHTS.get(g, 1), caps((d, g))) for g in {k[1] for k in leaves if k[0] == d}})
        for g, c in langs.items():
            for s, a in water_fill(c, {s: (1, caps((d, g, s))) for s in {k[2] for k in leaves if k[:2] == (d, g)}}).items():
                out[d, g, s] = a
    return leaves, out


@pytest.mark.parametrize("share,max_epochs,bucket_rows", [((1, 2), 2, 10_000), ((3, 2), 3, 7), ((1, 1), 1, 10), ((0, 1), 2, 10), ((9, 1), 2, 10)])
def test_mix_against_brute_force(spark, share, max_epochs, bucket_rows):
    docs = queries.table(spark, SF_SMALL, "documents").where("doc_id % 20 not in (1, 5, 9) or lang = 'en'")
    rows, leaves = mixing.plan(docs, share, max_epochs, 5, bucket_rows)
    known = [tuple(r) for r in rows.select(*mixing.LEVELS, "doc_id", "tokens").collect()]
    supply, want = brute_mix(known, share, max_epochs, 5)
    got = {tuple(r)[:3]: r for r in leaves.collect()}
    assert all(abs(got[k]["alloc"] - v) < 4 for k, v in want.items())
    assert sum(r["alloc"] for r in got.values()) == min(sum(supply.values()) * share[0] // share[1], sum(supply.values()) * max_epochs)
    taken = {}
    for r in mixing.selection(rows, leaves, 5).collect():
        taken.setdefault((r["m_domain"], r["m_lang"], r["m_source"]), []).append((r["epoch"], r["doc_id"], r["take"]))
    for leaf, row in got.items():
        own = [(d, t) for *path, d, t in known if tuple(path) == leaf and t]
        expect = [(e, d, t) for e in range(1, row["epochs"] + 1) for d, t in own]
        rest, e = row["alloc"] - row["epochs"] * supply[leaf], row["epochs"] + 1
        for d, t in sorted(own, key=lambda x: (hashlib.md5(f"5:{e}:{x[0]}".encode()).hexdigest(), x[0])):
            if rest > 0:
                expect.append((e, d, min(t, rest)))
                rest -= t
        assert sorted(taken.get(leaf, [])) == sorted(expect)


def test_mix_odd_rows(odd_docs, make_docs):
    rows, leaves = mixing.plan(odd_docs, (1, 1), 1, 3)
    assert sorted(r["doc_id"] or 0 for r in mixing.selection(rows, leaves, 3).collect()) == sorted(r["doc_id"] or 0 for r in odd_docs.collect() if words(r["text"]))
    assert {r["m_lang"] for r in leaves.collect()} == {"en", mixing.NONE}
    out = mixing.mixed(odd_docs, (1, 1), 3)
    assert out.columns == odd_docs.columns and out.count() == 9
    rows, leaves = mixing.plan(make_docs([]), (1, 2), 2, 3)
    assert mixing.selection(rows, leaves, 3).collect() == [] and mixing.mixed(make_docs([]), (1, 2), 3).collect() == []


@pytest.mark.parametrize("name", ["op5_license_diagonals", "op7_decontaminate", "op10_mix_budgets"])
def test_no_python_in_the_plan(spark, name):
    plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|CartesianProduct", plan)
