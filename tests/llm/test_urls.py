from motifloom.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[:end]


def rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = [
    "https://WWW.Example.com/en/x?y#z", "http://example.com/en/", "http://a.example.com/en/b", "http://example.com/de/", "http://example.com", "http://x.net/es/1", "http://net/fr/a", "http://x.net/en/",
    "no scheme", "", None, "http://xnet/es/", "ftp://h?q=/net/es/", "a://b://c/d", "http://notexample.com/en/", "http://ÉX.org/p", "http://example.com/en#f", "https://h.org:80/p?a=1&b=2#t", "://x.com/",
]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, 7) for i, u in enumerate(URLS)] + [(None, URLS[0], 7), (0, URLS[0], 7)], "page_id long, url string, host int")
    empty = spark.createDataFrame([], "url string, bad boolean")
    got = urls.judge(pages, empty).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path = split(URLS[r["page_id"] or 0])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, name, verdict or "allow")
    assert urls.judge(pages.where("false"), empty).count() == 0


def test_mined_rules(spark):
    bad = [f"http://{s}.bad.org/{p}/{i}" for i in range(30) for s in ("a", "b") for p in ("x", "y")]
    mixed = [f"http://m.odd.org/{p}/{i}?k=1" for i in range(40) for p in ("fine", "evil")]
    good = [f"http://g{i % 9}.good.org/x/{i}" for i in range(200)]
    labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, "/evil/" in u) for u in mixed] + [(u, False) for u in good], "url string, bad boolean")
    rules = {frozenset(r["needs"]): r for r in urls.mined_rules(labelled).collect()}
    assert frozenset({"d:bad.org"}) in rules or frozenset({"h:bad"}) in rules
    assert frozenset({"p:evil"}) in rules and all(r["confidence"] >= 0.6 for r in rules.values())
    assert all(not a < b or rules[a]["confidence"] < rules[b]["confidence"] for a in rules for b in rules)
    pages = spark.createDataFrame([(1, "http://q.bad.org/new"), (2, "http://m.odd.org/fine/9"), (3, "http://m.odd.org/evil/z"), (4, "http://g1.good.org/x/8"), (5, "http://sub.example.com/en/evil"), (6, None)], "page_id long, url string")
    want = {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block", 6: "allow"}
    for s in (urls.Settings(), urls.Settings(broadcast_rules=0)):
        assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, labelled, s).collect()} == want


def test_plan_is_native(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.org/b", "<p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 0, 1), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = urls.op9_url_filters(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "InArrow", "InPandas", "html"))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
