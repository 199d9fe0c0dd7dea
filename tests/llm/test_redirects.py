import random

import duckdb
from helpers import ordered

from demandloom.llm.queries import SQL, URL_RULES
from demandloom.llm.redirects import Rule, alias_edges, judge_urls, with_rules
from tools.check_oracle import compare

RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
SCHEMA = "page_id long, url string, html string, node string, host int"


def canonical(target):
    return f"<html><LINK href='{target}' rel=\"canonical\"><p>rel=canonical</p>"


PAGES = [
    (1, "http://A.example.ORG/es/x?q#f", "", "n", 1),
    (2, "https://example.org:80/es/x", "", "n", 1),
    (3, "https://org", None, "n", 1),
    (4, None, "", "n", 1),
    (5, "no scheme/path", canonical("http://a.com/de/1"), "n", 1),
    (6, "http://x.com/de/a", "", "n", 1),
    (7, "http://alias.net/1", canonical("http://x.com/de/a"), "n", 1),
    (8, "http://alias.net/2#top", canonical("//alias.net/1"), "n", 1),
    (9, "http://alias.net/3", '<meta http-equiv="refresh" content="0; url=/2">', "n", 1),
    (10, "http://two.net/", canonical("http://y.com/de/b"), "n", 1),
    (11, "http://y.com/fr/b", canonical("http://two.net/"), "n", 1),
    (12, "http://gone.net/1", canonical("http://never.crawled.com/de/"), "n", 1),
    (13, "http://plain.net/", "<link rel=stylesheet href=http://x.com/de/a>", "n", 1),
    (14, "http://far.net/", "", "n", 1),
    (15, "http://s.com/de", "", "n", 1),
    (16, "http://q.org?x/es/", "", "n", 1),
    (7, "http://alias.net/1", canonical("http://x.com/de/a"), "n", 1),
]


def test_rules_aliases_and_precedence(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    redirects = spark.createDataFrame([("http://far.net/", "http://alias.net/3"), (None, "x")], "source string, target string")
    got = judge_urls(pages, RULES, redirects).select("page_id", "host", "path", "rule", "verdict").collect()
    assert ordered(got) == ordered(
        [
            (1, "a.example.org", "/es/x", "example.org/es/", "block"),
            (2, "example.org:80", "/es/x", None, "allow"),
            (3, "org", "", None, "allow"),
            (4, "", "", None, "allow"),
            (5, "", "", None, "allow"),
            (6, "x.com", "/de/a", "com/de/", "block"),
            (7, "alias.net", "/1", None, "block"),
            (7, "alias.net", "/1", None, "block"),
            (8, "alias.net", "/2", None, "block"),
            (9, "alias.net", "/3", None, "block"),
            (10, "two.net", "/", None, "allow"),
            (11, "y.com", "/fr/b", "com/fr/", "allow"),
            (12, "gone.net", "/1", None, "block"),
            (13, "plain.net", "/", None, "allow"),
            (14, "far.net", "/", None, "block"),
            (15, "s.com", "/de", None, "allow"),
            (16, "q.org", "", None, "allow"),
        ]
    )


def test_hub_of_aliases_and_empty_table(spark):
    pages = [(k, f"http://a{k}.net/", canonical("http://hub.com/de/"), "", 0) for k in range(200)]
    got = judge_urls(spark.createDataFrame(pages, SCHEMA), RULES)
    assert {r.verdict for r in got.collect()} == {"block"}
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert judge_urls(spark.createDataFrame([], SCHEMA), RULES).count() == 0
    assert {r.verdict for r in judge_urls(spark.createDataFrame(pages, SCHEMA), []).collect()} == {"allow"}


def test_relative_targets_are_resolved(spark):
    page = "http://R.net/a/b/c.html?old=1#top"
    targets = {
        "next.html": "http://r.net/a/b/next.html",
        "./d/": "http://r.net/a/b/d/",
        "../e?x=/../1": "http://r.net/a/e?x=/../1",
        "../../../f": "http://r.net/f",
        "..": "http://r.net/a/",
        "g/./h/../i": "http://r.net/a/b/g/i",
        "?id=3": "http://r.net/a/b/c.html?id=3",
        "/j/../k": "http://r.net/k",
        "go?to=http://x.com/": "http://r.net/a/b/go?to=http://x.com/",
        "//s.net/l": "http://s.net/l",
        "https://t.net/m/../n": "https://t.net/m/../n",
        "#part": None,
        "mailto:someone": None,
    }
    for target, full in targets.items():
        html = f'<meta http-equiv="refresh" content="0; url={target}">'
        got = alias_edges(spark.createDataFrame([(1, page, html, "n", 1)], SCHEMA)).collect()
        assert [r.target for r in got] == ([full] if full else []), target
    bare = [(1, "http://u.net", canonical("v"), "n", 1), (2, "http://u.net", canonical("?w"), "n", 1)]
    bare.append((3, "http://u.net/", '<meta http-equiv="refresh" content="30">', "n", 1))
    got = alias_edges(spark.createDataFrame(bare, SCHEMA)).collect()
    assert {r.target for r in got} == {"http://u.net/v", "http://u.net/?w"}


def test_blocks_reach_relative_aliases(spark):
    pages = [
        (1, "http://alias.net/p/1.html", canonical("2.html"), "n", 1),
        (2, "http://alias.net/p/2.html", canonical("../q?id=3"), "n", 1),
        (3, "http://alias.net/q?id=3", canonical("http://x.com/de/a"), "n", 1),
    ]
    got = judge_urls(spark.createDataFrame(pages, SCHEMA), RULES).collect()
    assert [r.verdict for r in got] == ["block"] * 3


def test_rules_as_a_table_decide_alike(spark):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "example.org:80", ""]
    paths = ["/", "/d", "/de/", "/de/a", "/e", ""]
    rules = {(h, p): Rule(rng.choice(["allow", "block"]), h, p) for h in hosts[:-1] for p in paths[:-1] if rng.random() < 0.6}
    rules = list(rules.values())
    urls = [(rng.choice(["", "q.", "z.b."]) + h, rng.choice(paths) + rng.choice(["", "x", "/y"])) for h in hosts for _ in range(40)]
    df = spark.createDataFrame([(*u, k) for k, u in enumerate(urls)], "host string, path string, k int")
    planned = ordered(with_rules(df, rules).collect())
    assert planned == ordered(with_rules(df, rules, planned=0).collect())
    pages = spark.createDataFrame(PAGES, SCHEMA)
    assert ordered(judge_urls(pages, RULES).collect()) == ordered(judge_urls(pages, RULES, planned=0).collect())


def test_a_hundred_thousand_rules(spark):
    """Also many on one host."""
    rules = spark.range(100_000).selectExpr(
        "if(id % 2 = 0, 'block', 'allow') as verdict",
        "if(id % 4 < 2, 'hot.com', concat('h', id, '.net')) as host",
        "concat('/', id, '/') as path",
    )
    pages = [(k, f"http://www.hot.com/{k * 4 + k % 4}/x", "", "", 0) for k in range(400)]
    pages += [(1000 + k, f"http://h{k}.net/{k}/", "", "", 0) for k in range(400)]
    got = judge_urls(spark.createDataFrame(pages, SCHEMA), rules).collect()
    for r in got:
        n = r.page_id * 4 + r.page_id % 4 if r.page_id < 1000 else r.page_id - 1000
        known = n % 4 < 2 if r.page_id < 1000 else n % 4 >= 2
        host = "hot.com" if r.page_id < 1000 else f"h{n}.net"
        assert r.rule == (f"{host}/{n}/" if known else None)
        assert r.verdict == ("block" if known and n % 2 == 0 else "allow")


def test_sql_resolves_relative_links_too(spark, tmp_path):
    pages = [
        (1, "http://alias.net/p/1.html", canonical("2.html")),
        (2, "http://alias.net/p/2.html", canonical("./x/../../q?id=3")),
        (3, "http://alias.net/q?id=3", canonical("http://x.com/de/a")),
        (4, "http://far.net/a/b", canonical("/../c/.")),
        (5, "http://far.net/c/", canonical("//x.com/de/b")),
        (6, "http://far.net/d", canonical("?z")),
        (7, "http://far.net/d?z", canonical("mailto:x")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    frame = judge_urls(df, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
    assert compare(frame, SQL["op4_url_filter"], con) is None
    assert [r.verdict for r in frame.orderBy("page_id").collect()] == ["block"] * 5 + ["allow"] * 2
