import duckdb

from docloom.llm import url_rules as U


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if c < "\x7f" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else U.DEFAULT


def test_whole_table(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(duck.execute(U.ORACLES["op7_url_rules"]).fetchall(), key=str)
    assert sorted(map(tuple, U.op7_url_rules(spark, sf).collect()), key=str) == want
    urls = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    assert all(tuple(r[1:]) == brute(urls[r[0]], U.RULES) for r in want)


def test_nested_rules_and_edges(spark):
    rules = [("org", "/", "allow"), ("b.org", "/", "block"), ("a.b.org", "/x/", "allow"), ("a.b.org", "/x/y", "block"), ("b.org", "/x/y/z/long", "allow"), ("rg", "/", "block"), ("c", "", "block")]
    urls = [None, "", "nope", "http://", "HTTP://A.B.Org/x/yz?q#f", "http://b.org", "http://b.org/", "http://bb.org/x/y", "http://a.b.org/x/y/z/longer", "http://q.a.b.org/x/", "x://c?u", "x://é.c#/x", "a://b://c/d", "http://org/" + "p" * 50_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(4, urls[4]), (None, urls[4])] + [(100 + i, "http://b.org/x") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS key", "'u' AS uid", "0 AS stack")
    given = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    got = sorted(map(tuple, U.judge_urls(df, given).collect()), key=str)
    assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=str)
    assert {r.verdict for r in U.judge_urls(df, given.limit(0)).collect()} == {U.DEFAULT}
    assert U.judge_urls(df.limit(0), given).count() == 0
