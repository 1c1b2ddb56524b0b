import pytest

from tests.conftest import SF_SMALL
from tools.check_oracle import duck_con, rows_of
from tuneforge.llm import queries, url_filter

PAGE = "page_id long, url string, html string, host string, alias string"
canonical = lambda u: f'<html><head><link rel="canonical" href="{u}"></head>'
refresh = lambda u: f"<META HTTP-EQUIV='refresh' content='0; url={u}'>"

ROWS = [
    (1, "http://a.net/x", ""), (2, "http://alias.io/x", canonical("http://a.net/x")), (3, "http://far.io/y#frag", refresh("http://alias.io/x?utm_source=q")),
    (4, "https://WWW.Example.NET/en/1?ref=x", ""), (5, "http://b.io/1", canonical("https://www.example.net/en/1")), (6, "http://b.io/2", canonical("http://b.io/1") + refresh("http://a.net/zzz")),
    (7, "http://org/fr/", None), (8, "http://notorg/fr/", ""), (9, "http://example.com/de", ""), (10, "http://sub.example.com/de/?q", ""), (11, "no scheme net/", "<link rel=canonical href=http://a.net/x>"),
    (12, None, canonical("http://a.net/x")), (None, "http://x.net", ""), (13, "http://x.net/", ""), (13, "http://x.net/", ""), (14, "", ""), (15, "http://c.io/deep/p", canonical("/other")), (16, "http://c.io/other", canonical("//d.net/q")),
    (17, "x://y://z.net/", ""), (18, "http://exampleXnet/en/", ""),
]
WANT = {1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("example.net/en/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"),
        10: ("example.com/de/", "block"), 11: (None, "block"), 12: (None, "allow"), None: (None, "allow"), 13: ("net/", "block"), 14: (None, "allow"), 15: (None, "block"), 16: (None, "block"), 17: (None, "allow"), 18: (None, "allow")}


#: Links of every form to a blocked page and to an allowed one: (page, link); each page must share their verdicts.
LINKS = [
    ("http://n.io/a/b/page", "target.html"), ("http://n.io/a/b/c/page", "../target.html"), ("http://n.io/a/b/c/d/page?x=/y", "./.././../target.html"), ("http://n.io/z#f", "/q/.././a/b/target.html"),
    ("http://n.io", "a/b/target.html"), ("http://n.io/up", "../../a/b/target.html"), ("http://n.io/s/", "//n.io/a/b/target.html"), ("http://n.io/a/b/target.html?k=1", "?k=2&amp;l=3"), ("http://n.io/amp", "/a/b/target.html?k=2&#38;l=3"),
    ("http://m.io/go", "/t?u=https://zz.io/x"), ("http://m.io/away", "http://n.io/t/../a/b/target.html"),
]
FORMS = [(100 + i, page, (canonical if i % 2 else refresh)(link)) for i, (page, link) in enumerate(LINKS)]
FORMS += [(200, "http://n.io/a/b/target.html", canonical("http://blocked.net/")), (201, "http://n.io/a/b/target.html?k=2&l=3", canonical("/a/b/target.html")), (202, "http://m.io/t?u=https://zz.io/x", canonical("http://other.net/")),
          (203, "https://zz.io/x", ""), (204, "http://m.io/mail", canonical("mailto:a@blocked.net")), (205, "http://m.io/self", canonical("#top")), (206, "http://m.io/none", canonical(""))]
FORMS_WANT = {p: "block" for p, _, _ in FORMS} | {203: "allow", 204: "allow", 205: "allow", 206: "allow"}


@pytest.fixture(params=[ROWS, FORMS], ids=["rules", "links"])
def table(request):
    return request.param


@pytest.fixture
def pages(spark, table):
    return spark.createDataFrame([(*r, "clash", "clash") for r in table], PAGE)


@pytest.mark.parametrize("table", [FORMS], indirect=True)
def test_links_of_every_form(pages):
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(pages).collect()} == FORMS_WANT


def test_very_long_page(spark):
    html = "<p>" + "x " * 1_000_000 + canonical("../b") + "<link " * 1000
    pages = spark.createDataFrame([(1, "http://a.io/c/d", html, "", ""), (2, "http://a.io/b", canonical("http://x.net/"), "", "")], PAGE)
    assert [r["verdict"] for r in url_filter.judge_pages(pages).orderBy("page_id").collect()] == ["block", "block"]


@pytest.mark.parametrize("table", [ROWS], indirect=True)
def test_rules_and_aliases(pages):
    rows = url_filter.judge_pages(pages).collect()
    assert len(rows) == len(ROWS)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == WANT
    by = {r["page_id"]: r for r in rows}
    assert (by[4]["host"], by[4]["path"], by[10]["path"], by[14]["host"], by[11]["host"], by[17]["host"]) == ("www.example.net", "/en/1", "/de/", "", "", "y:")


def test_sql_agrees_on_aliases(spark, pages, tmp_path):
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    con = duck_con(SF_SMALL)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/p/*.parquet')")
    rel = con.sql(queries.SQL["op8_url_aliases"])
    rows = url_filter.judge_pages(pages).select("page_id", "host", "path", "rule", "verdict")
    assert rows_of([tuple(r) for r in rows.collect()], rows.columns) == rows_of(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("table", [ROWS], indirect=True)
def test_empty(pages):
    assert url_filter.judge_pages(pages.where("false")).collect() == []


@pytest.mark.parametrize("table", [FORMS], indirect=True)
def test_steps_of_a_link_do_not_repeat_one_another(pages):
    """The plan is written, optimized and compiled by the driver: it holds each step once, not each within all later ones."""
    plan = url_filter.alias_edges(pages)._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 50_000
