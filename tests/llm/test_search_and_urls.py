"""Top-k search, URL filters and the pipeline."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from assetloom.llm import registry, topk, urlfilter


def brute(rows, queries, top):
    out = []
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    known = [(i, whole(v)) for i, v in rows if i is not None and fine(v)]
    for q, v in ((i, whole(v)) for i, v in queries if i is not None and fine(v)):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in known if i != q)[:top]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell int"


@pytest.mark.parametrize("cell", [4096, 16])
def test_top_k(spark, monkeypatch, cell):
    """With cells of 16 rows the bounds go out in several passes, and cells and parts meet by a join."""
    monkeypatch.setattr(topk, "SENT_CELLS", cell // 4)
    monkeypatch.setattr(topk, "SENT_PAIRS", cell // 4)
    monkeypatch.setattr(topk, "CELL_ROWS", cell)
    monkeypatch.setattr(topk, "CELL_QUERIES", cell)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype("f4")]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(120, 180)] + [(3, [1.0] * 6), (3, [1.0] * 6)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [9.0] * 6), (204, []), (206, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    queries = df.where("vec_id % 3 = 0")
    got = sorted(tuple(r) for r in topk.top_k(df, queries).collect())
    assert got == brute(rows, [(i, v) for i, v in rows if i is not None and i % 3 == 0], 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.where("vec_id = 0"), top=500).count() == len([1 for i, v in rows if i not in (None, 0, 200, 201, 202, 203)])


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    centres = np.eye(8) * 100
    matrix = np.concatenate([c + rng.integers(-3, 4, (topk.BLOCK_ROWS, 8)) for c in centres])
    _, scored = topk.search_cell(centres, np.full(8, -1), np.full(8, -np.inf), matrix, np.arange(len(matrix)), 5)
    assert scored == 8


def test_queries_are_sent_only_to_cells_that_can_hold_something(spark):
    """Eight far clusters, a cell each: every query stays in its own cell."""
    from types import SimpleNamespace

    import pyarrow as pa

    centres = np.eye(8) * 100
    boxes = SimpleNamespace(value=(np.arange(8), centres + 3, centres - 3))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(centres.astype(int).tolist(), pa.list_(pa.int64())), pa.array([9000] * 8)], ["query_row", "q_id", "q_v", "floor"])
    for vectors in (True, False):
        sent = [(c, p) for out in topk._ship_batches([batch], boxes, 1, vectors) for c, p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        assert sent == [(c, 0) for c in range(8)]


def test_large_components_stay_exact():
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])
    assert topk._product(a, b)[0, 0] == 2**60 + 1


URLS = [
    "https://a.org/x", "http://org/", "http://x.org", "http://myorg/x", "https://EXAMPLE.org/es/1?q", "http://sub.example.org/en/123#t", "http://example.org/en/2", "http://example.org.evil.net/es/", "https://a.com/fr/1",
    "https://a.com/de/1", "https://a.com/DE/1", "ftp://u@b.com:80/de/", "no scheme", "", None, "x://", "http://a.b?u=http://c.org/", "https://spam-farm.example.net/en/1", "https://notspam.net/", "http://x.net/a\nb?c", "http://com/de/x", "http://adult.net", "http://a.adult-x.net:8080/", "http://x.net/adult/",
]


def judged(url, rules):
    import re

    host = path = ""
    if url is not None and (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)):
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = []
    for verdict, h, p in urlfilter.HOST_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), h + p, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    label = re.split("[.-]", re.sub(":.*", "", host))
    low = "".join(c.lower() if c.isascii() else c for c in path)
    steps = low.split("/")
    folder = any(s in urlfilter.BLOCKED_FOLDERS and "/".join(steps[i + 1 :]) for i, s in enumerate(steps) if 0 < i < len(steps) - 1)
    last = low.removesuffix("/").split("/")[-1] if low else ""
    page = any(last == p + e for p in urlfilter.BLOCKED_PAGES for e in ("", *("." + e for e in urlfilter.PAGE_ENDINGS)))
    stem, _, ending = steps[-1].rpartition(".")
    file = ending in urlfilter.COUNTING_ENDINGS and bool(set(re.split("[^a-z0-9]", stem)) & set(urlfilter.COUNTING))
    return host, path, None, "block" if set(label) & set(urlfilter.BLOCKED_WORDS) or folder or page or file else "allow"


PATHS = [
    "/ads/x.html", "/ads/", "/ads//", "/ADS/x", "/x/y/pagead/z", "/loads/x", "/ads-x/y", "/x/ads", "/login", "/Login.PHP", "/login/", "/login//", "/login/x", "/user/sign-in.aspx", "/x-login", "/login.phpx", "/cart.do?x", "/cart\n",
    "/pixel.gif", "/a/b/my-pixel.1x1.PNG", "/pixels.gif", "/pixel-.gif", "/pixel/x.gif", "/x.pixel", "/-pixel.js#a", "/é/pixelé.svg", "/collect.html", "/" + "a/-" * 20000 + "tracker.gif", "/" + "pixel" * 4000,
]


def test_rules_of_paths(spark):
    rows = [(i, "http://www.x.net" + p) for i, p in enumerate(PATHS)] + [(100 + i, "http://a.org" + p) for i, p in enumerate(PATHS)]
    got = {r[0]: tuple(r)[1:] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {i: judged(u, None) for i, u in rows}
    assert 10 < sum(r[3] == "block" for r in got.values()) < 20 and len(urlfilter.default_rules()) > 300


def test_only_rules_of_a_token_run(spark, monkeypatch):
    urls = spark.createDataFrame([(f"www.x.net{p}",) for p in PATHS], "key string")
    table = urlfilter.rule_table(spark, urlfilter.default_rules())
    met = urlfilter.fetched(urls, urlfilter.rule_index(table, urls)).select("key", "token").collect()
    assert all(r.token in r.key.lower() for r in met)
    # Some in a hundred of all pairs.
    assert len(met) < 0.03 * len(PATHS) * table.count()
    pages = urls.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "key").alias("url"))
    want = sorted(urlfilter.judge(pages).collect())
    monkeypatch.setattr(urlfilter, "SENT_RULES", 0)
    assert sorted(urlfilter.judge(pages, table).collect()) == want
    # A caller's own table, an empty one among them.
    own = spark.createDataFrame([("mine", "block", "pixel", ["pixel"], 5, False, 1)], urlfilter.RULES + ", more int")
    assert {r.verdict for r in urlfilter.judge(pages, own).collect()} == {"allow", "block"}
    assert {r.verdict for r in urlfilter.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_url_rules(spark, small):
    pages = spark.createDataFrame([(i, u, "<p>", "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "", "", ""), (0, URLS[0], "", "", "")], "page_id long, url string, html string, host string, rule string")
    for docs in (pages, spark.read.parquet(f"{small}/pages.parquet"), pages.limit(0)):
        got = sorted(map(repr, (tuple(r) for r in urlfilter.judge(docs).collect())))
        assert got == sorted(repr((r.page_id, *judged(r.url, None))) for r in docs.collect())


def test_rules_lie_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"a{i}.org/es/",) for i in range(5)] + [("example.org/en/",)], "key string")
    index = {r.rule_name: r.token for r in urlfilter.rule_index(urlfilter.rule_table(spark, urlfilter.default_rules() + [urlfilter.Rule("any", "allow", "^q", (), 1, False)]), urls).collect()}
    assert index["example.org/es/"] == "example" and index["org/"] == "org" and index["any"] is None and index["example.org/en/1"] in ("en", "example")


def test_sql_agrees(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    for query, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[query](spark, small)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        rows = sorted(map(repr, want.fetchall()))
        assert rows == sorted(map(repr, (tuple(r) for r in df.select(names).collect())))


def test_pipeline_stages(spark, small):
    """The run against its stages one by one, each of which has tests of its own."""
    import corpus_pipeline
    from assetloom.llm import decontaminate, mixing, nearcopies, quality

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("labels", "benchmark"))
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    model = quality.fit(docs, labels)
    good = {r.doc_id for r in quality.score(docs, model).where(f"score >= {quality.THRESHOLD}").collect()}
    step = docs.where(docs.doc_id.isin(good))
    step = step.where(step.doc_id.isin({r.doc_id for r in nearcopies.keep_one(step).collect()}))
    hit = {r.doc_id for r in decontaminate.contaminated(step, bench).collect()}
    step = step.where(~step.doc_id.isin(hit)) if hit else step
    copies = {r.doc_id: len(r.copies) for r in mixing.mix_plan(step).collect()}
    out = corpus_pipeline.run(spark, small)
    assert out.columns == [*docs.columns, "size", "text_crc32", "virtual_slot", "slot_bytes", "shard", "slot"]
    got, texts = out.collect(), {r.doc_id: r.text for r in docs.collect()}
    count = {k: sum(r.doc_id == k for r in got) for k in copies}
    assert count == copies and len(got) == sum(copies.values())
    assert all(r.text == texts[r.doc_id] and 0 <= r.shard < 16 for r in got)
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_pipeline_stages_take_odd_and_no_rows(spark, small):
    """Nulls in every column, repeated ids with other texts, empty and long texts, more columns; and no rows at all."""
    import corpus_pipeline

    rows = [(i % 40 if i % 9 else None, [None, "", "one", f"text {i} of some words that differ a little", "long " * 50_000][i % 5], "en" if i % 2 else None, [None, "a", "b"][i % 3], None, "x", "y") for i in range(120)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, shard string")
    for docs in (odd, odd.limit(0)):
        had = {repr(r) for r in docs.collect()}
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.schema == docs.schema and {repr(r) for r in out.collect()} <= had
            docs = out if stage is not corpus_pipeline.keep_quality else docs
        out = corpus_pipeline.shard(spark, docs, small)
        assert out.count() == docs.count() and {"text", "size", "shard", "slot"} <= set(out.columns)
