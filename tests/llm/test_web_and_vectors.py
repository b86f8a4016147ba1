"""Style tree, WARC, multi-index search, tool links and the pipeline."""

import gzip
import hashlib
import html as entities
import json
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import multi_index, style_tree, tool_links, warc
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, host string"


def test_semantic_page():
    page = (
        '<html><body class="has-sidebar"><header><h2>Site</h2></header><div id="cookie-notice">We use</div><main>'
        '<article class="post"><header><h1>T &amp; x</h1><div>by me</div></header><div><p>One<br>two&nbsp;three '
        "<a href=x>link</a> end<p>Second <i>it</i><ul><li>a<li>b</ul><form><input>q</form>"
        '<div class="share-bar">Share</div><script>var x = "</p>";</script></div><section id="comments">'
        '<article class="comment">Nice!</article></section></article></main><aside>side</aside><footer>f</footer>'
    )
    assert style_tree.Extractor({})(page) == "T & x\nOne two three link end\nSecond it\na\nb"


def test_all_main_elements_that_are_not_hidden():
    text = style_tree.Extractor({})
    body = "<div itemprop=articleBody><p>{}</div>"
    assert text(f"<body>{body.format('One')}<div class=ad>Buy</div>{body.format('Two')}") == "One\nTwo"
    assert text("<main hidden><p>Draft<article>Old</article></main><main><p>Now<div role=main>in it</div></main><main><p>Too</main>") == "Now\nin it\nToo"
    assert text("<div hidden><main>Draft</main></div><article style='display: none'>Old</article><article>New</article>") == "New"


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "a < b", "<div " * 50, "<b>" * 5000 + "x", "<!-- x", '<a href="x', "</p></div>"])
def test_odd_pages_dont_crash(page):
    assert isinstance(style_tree.Extractor({})(page), str)
    style_tree.observations(page)


def site(k, host="h.example"):
    return f"http://{host}/{k}", (
        f"<body><div class=x1><div>Home</div><div>About us</div></div><div class=x2><p>Story {k} tells of thing {k * 7}."
        f"<p>More of {k}.</div><div class=x3>All rights kept by us</div></body>"
    )


@pytest.mark.parametrize("limit", [100_000, 0])
def test_site_style_tree_removes_what_pages_share(spark, limit):
    rows = [(k, *site(k), "own", "clash") for k in range(20)] + [(50, *site(3), "own", None), (51, None, site(1)[1], None, None)]
    rows += [(60, "http://lone.example/", site(2)[1], None, None), (61, "http://h.example/z", None, None, None), (None, "odd", "<p>t", None, None)]
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, PAGES), limit).collect()}
    assert all(got[k] == f"Story {k} tells of thing {k * 7}.\nMore of {k}." for k in range(20))
    assert got[50] == got[3] and got[61] == "" and got[None] == "t"
    assert got[51].startswith("Home\nAbout us\n") and got[60].startswith("Home")  # nothing to compare with


@pytest.mark.parametrize("limit", [100_000, 0])
def test_copies_of_an_article_keep_their_text(spark, limit):
    long = [f"Part {k} of the long story." for k in range(20)]

    def page(host, k, blocks):
        shown = f"<nav>Menu {k}</nav><div class=k{k}>Ad {k}</div><script>{k}</script><article>" + "".join(f"<p>{b}</p>" for b in blocks)
        return k, f"http://{host}.example/{k}", f"<body>{shown}</article>", None, None

    same = [page("one", k, long) for k in range(12)]
    near = [page("near", 100 + k, [*long[:k], f"Corrected {k}.", *long[k + 1 :]]) for k in range(12)]
    few = [page("few", 200 + k, long) for k in range(30)] + [page("few", 300 + k, [f"Only {k}."]) for k in range(2)]
    fixed = [page("fixed", 400 + k, [f"News {k}.", "Write to the editor.", f"More {k}."]) for k in range(12)]
    rows = same + near + few + fixed
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, PAGES), limit).collect()}
    assert all(got[k] == "\n".join(long) for k in [*range(12), *range(200, 230)])
    assert all(got[100 + k] == "\n".join([*long[:k], f"Corrected {k}.", *long[k + 1 :]]) for k in range(12))
    assert got[300] == "Only 0." and got[301] == "Only 1."
    assert all(got[400 + k] == f"News {k}.\nMore {k}." for k in range(12))


def test_article_text_of_the_driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|</h1>", inner))
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = QUERIES["op4_style_tree"](spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.fixture
def archive_rows():
    big = "<p>" + "é" * 200
    return [(5, "http://a/1", big), (3, "http://a/2 x\n", big), (9, None, big), (3, "http://a/2", big), (None, "u", big), (7, "v", "small"),
            (8, "v", "small"), (1, "n", None), (10, "long", "z" * 3_000_000)]


def test_warc_round_trip(spark, archive_rows, tmp_path):
    pages = spark.createDataFrame([(*r, 1) for r in archive_rows], "page_id long, url string, html string, digest int")
    manifest = warc.write(pages, f"file://{tmp_path}/a", shard_bytes=1000, file_bytes=500).collect()
    assert len(manifest) > 3 and sum(r["records"] for r in manifest) == len(archive_rows)
    want = Counter()
    for i, _, page in archive_rows:
        data = (page or "").encode()
        again = len(data) >= 100 and page.startswith("<p>") and i != 3
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    got = warc.read(spark, f"file://{tmp_path}/a", payloads=True).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {p or "" for _, _, p in archive_rows}
    # Written again, the files are the same bytes; each record is a gzip member that plain tools read.
    second = warc.write(pages.repartition(3), f"file://{tmp_path}/b", shard_bytes=1000, file_bytes=500).collect()
    assert sorted(manifest) == sorted(second)
    for r in manifest:
        data = (tmp_path / "a" / r["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert not (tmp_path / "a" / "_temporary").exists()


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(pages, f"file://{tmp_path}/a").count() == 0 and warc.read(spark, f"file://{tmp_path}/a").count() == 0


def brute(rows, k=10):
    out = {}
    for q, x in rows.items():
        if q % 100 == 0:
            near = sorted((math.dist(x, y), i) for i, y in rows.items() if i != q)[:k]
            out[q] = [(i, s) for s, i in near]
    return out


def search(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int")
    found = {}
    for r in multi_index.search(frame, F.col("vec_id") % 100 == 0, **more).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_search_recall(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 32)).astype("f4")
    x[700:1000] = x[1]  # one vector held by a fifth of the rows
    rows = {k: v.tolist() for k, v in enumerate(x)}
    got, want = search(spark, [(k, v, 1) for k, v in rows.items()]), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert got[700] == [(i, 0.0) for i in [1, *range(701, 710)]]
    same = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert same >= 0.9 * 10 * len(want)
    for q in got:
        assert all(s == pytest.approx(math.dist(rows[q], rows[i]), abs=1e-9) for i, s in got[q])


def test_search_with_few_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 2)
    nan, inf = float("nan"), float("inf")
    rows = {0: [1.0, 0.0], 1: [0.0, 1.0], 100: [1.0, 1.0], 200: [-1.0, -1.0], 5: [1.0, 1.0]}
    odd = [(300, None, 1), (400, [0.0, 0.0], 1), (500, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (9, [], 1), (None, [1.0, 2.0], 1)]
    got = search(spark, [(k, v, 1) for k, v in rows.items()] + odd + [(0, [1.0, 0.0], 2)])
    want = brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert search(spark, odd[:1]) == {}


ODD_PAGES = {
    "open quotes": '<a "',
    "open name": "<aaaa",
    "long name": "<" + "a" * 50_000 + ' "> ',
    "open comment": "<!-- x ",
    "quoted ends": '<a ">"',
    "open declaration": "<!x ",
    "angle brackets": "<",
    "open script": "<script>x</scrip",
    "two quotes": "<a '\">",
    "unclosed elements": "<div>",
}


@pytest.mark.parametrize("case", ODD_PAGES)
def test_odd_pages_are_parsed_in_linear_time(case):
    unit = ODD_PAGES[case]
    page = "<article><p>kept</p>" + unit * (2_000_000 // len(unit))
    start = time.perf_counter()
    style_tree.parse(page)
    assert time.perf_counter() - start < 20
    assert style_tree.Extractor({})("<article><p>kept</p></article>" + unit * 50).startswith("kept")


def test_markup():
    found = lambda page: [(m[2:], page[m[0] : m[1]]) for m in style_tree._markup(page)]
    assert found("a<b c='>' d>e</b ><!-- <i> --><!doctype x><?y?>< z") == [
        (("", "b", " c='>' d"), "<b c='>' d>"),
        (("/", "b", " "), "</b >"),
        (("", "", ""), "<!-- <i> -->"),
        (("", "", ""), "<!doctype x>"),
        (("", "", ""), "<?y?>"),
    ]
    assert found('<a "x> <b>') == [(("", "a", ' "x'), '<a "x>'), (("", "b", ""), "<b>")]
    assert found("1 < 2 <a") == [] and found("<b>x<!-- y") == [(("", "b", ""), "<b>"), (("", "", ""), "<!-- y")]
    long = f'<a href="{"x" * 9000}">t</a>'
    assert found(long)[0][0] == ("", "a", f' href="{"x" * 9000}"')


def test_odd_arguments(spark):
    deep = "[" * 100_000
    odd = {
        "lone": '{"query":"\\ud800"}',
        "deep": '{"query":' + deep + "]" * 100_000 + "}",
        "open": deep,
        "nan": '{"limit":NaN}',
        "huge": '{"limit":1e400}',
        "minus": '{"limit":-Infinity}',
        "text": "not json",
        "array": "[1]",
        "null": '{"query":null,"limit":1}',
        "number": '{"query":3,"limit":1}',
        "none": None,
    }
    schema = {"f": {"type": ["object"], "properties": {"query": {"type": ["string", "null"]}, "limit": {"type": "number"}, "no": False}}}
    calls = spark.createDataFrame([(1, k, 1, "f", v, None) for k, v in odd.items()], "conv_id long, call_id string, turn int, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, k, 2, "r") for k in odd], "conv_id long, call_id string, turn int, content string")
    got = {r["call_id"]: r for r in tool_links.link(calls, results, schema).collect()}
    assert {k for k, r in got.items() if r["status"] == "ok"} == {"lone", "null", "none"}
    assert {r["status"] for r in got.values()} == {"ok", "invalid"}
    for k, r in got.items():
        line = json.loads(r["line"], parse_constant=lambda c: pytest.fail(c))
        assert line["arguments"] == (odd[k] if r["status"] == "invalid" and k != "number" else json.loads(odd[k] or "{}"))
    assert "\\ud800" in got["lone"]["line"]
    with pytest.raises(ValueError):
        tool_links.link(calls, results, {"f": {"type": "strnig"}})


def test_tool_links(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "f", '{"x": 1, "a": {"z": 1, "b": [2]}}', None),
            (1, "b", 1, "f", '{"x": "no"}', ["a", "b", "gone", None]),
            (1, "c", 2, "f", '{"x": 2}', ["b", "a"]),
            (1, "d", 3, "f", '{"x": 3}', ["e"]),
            (1, "e", 4, "f", '{"x": 3}', ["d"]),
            (1, "g", 5, "other", None, ["d"]),
            (2, "a", 0, "other", "{}", []),
            (2, "a", 7, "f", "{}", []),
            (2, "h", 0, "f", "not json", []),
            (2, "i", 0, "f", '{"x": 9}', []),
            (None, "a", 0, "f", "{}", []),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame(
        [(1, "a", 1, 'r"é\n'), (1, "c", 3, None), (1, "lost", 9, "r"), (2, "a", 1, "q"), (1, "a", 5, "later"), (1, None, 1, "x")],
        "conv_id long, call_id string, turn long, content string",
    )
    schema = {"f": {"type": "object", "properties": {"x": {"type": "integer", "maximum": 8}}, "required": ["x"]}}
    got = {(r["conv_id"], r["call_id"]): r for r in tool_links.link(calls, results, schema).collect()}
    assert {k: (r["level"], r["status"], r["copies"]) for k, r in got.items()} == {
        (1, "a"): (0, "ok", 1), (1, "b"): (1, "invalid", 1), (1, "c"): (2, "ok", 1), (1, "d"): (None, "cycle", 1),
        (1, "e"): (None, "cycle", 1), (1, "g"): (None, "cycle", 1), (2, "a"): (0, "no_schema", 2), (2, "h"): (0, "invalid", 1),
        (2, "i"): (0, "invalid", 1), (1, "lost"): (None, "no_call", 1),
    }
    assert got[1, "a"]["line"] == '{"arguments":{"a":{"b":[2],"z":1},"x":1},"id":"a","name":"f","result":"r\\"é\\n"}'
    assert json.loads(got[2, "h"]["line"])["arguments"] == "not json"
    assert tool_links.link(calls.limit(0), results.limit(0), schema).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == sorted(frame.columns)
    assert Counter(repr(tuple(r[c] for c in order)) for r in frame.collect()) == Counter(repr(tuple(r)) for r in result.fetchall())


def test_pipeline_applies_each_stage(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near-dedup", "mixing", "encoding"]
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = corpus_pipeline.quality(spark, documents, SF)
    assert first.columns == documents.columns
    left = {r["doc_id"] for r in first.select("doc_id").collect()}
    marked = [i for i in labels if labels[i] == 1]
    assert len(left & set(marked)) >= 0.95 * len(marked)
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len({r["doc_id"] for r in out}) < documents.count()
    assert all(r["n_tokens"] > 0 for r in out)
