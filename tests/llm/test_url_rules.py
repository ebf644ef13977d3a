"""Listed rules on edge urls, mined rules against subsets counted by plain loops."""
import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import url_rules as U
from quarry.llm.queries import ORACLES, QUERIES, URL_RULES
from quarry.llm.shared import Scratch

EDGE = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/1?a=1&b=2&a=3#x"), (6, "http://example.com/en/"),
        (7, "http://example.com/en"), (8, "http://badexample.com/en/2"), (9, "http://a.b.example.com/en/x.html"), (10, "https://x.net/es/1"),
        (11, "https://x.net/de/1"), (12, "https://net/fr/9"), (13, "https://x.org"), (14, "https://x.org?u=http://example.com/en/"),
        (15, "http://É.com/\nen/"), (16, "http://example.com:80/en/1"), (17, "://com/x"), (18, "http://www.example.com/fr/" + "1/" * 5000),
        (None, "http://example.com/en/1"), (6, "http://example.com/en/"), (19, "a?b://c.com/d"), (20, "http://u.com#/en/")]
WANT = {1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("", "", None), 5: ("www.example.com", "/en/1", "www.example.com/en/"),
        6: ("example.com", "/en/", "example.com/en/"), 7: ("example.com", "/en", "com/"), 8: ("badexample.com", "/en/2", "com/"),
        9: ("a.b.example.com", "/en/x.html", "example.com/en/"), 10: ("x.net", "/es/1", "net/es/"), 11: ("x.net", "/de/1", None),
        12: ("net", "/fr/9", "net/fr/"), 13: ("x.org", "", None), 14: ("x.org", "", None), 15: ("É.com", "/\nen/", "com/"),
        16: ("example.com:80", "/en/1", None), 17: ("com", "/x", "com/"), 18: ("www.example.com", "/fr/" + "1/" * 5000, "com/"),
        None: ("example.com", "/en/1", "example.com/en/"), 19: ("c.com", "/d", "com/"), 20: ("u.com", "", None)}
EXTRA = "host string, path string, rule string, items string, id long, hit long, bad boolean"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "p", "r", "i", 9, 9, True) for i, u in rows], f"page_id long, url string, {EXTRA}").repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "id long, bad boolean")


def test_listed_rules(spark):
    out = U.judge(pages(spark, EDGE), "page_id", "url", labels(spark, [(None, True), (999, True)]), URL_RULES).collect()
    assert len(out) == len(EDGE)
    verdicts = {None: "allow", **{n + s: v for v, n, s in URL_RULES}}
    for r in out:
        assert (r.host, r.path, r.rule) == WANT[r.page_id] and r.verdict == verdicts[WANT[r.page_id][2]]


def test_empty_tables(spark):
    assert U.judge(pages(spark, []), "page_id", "url", labels(spark, []), URL_RULES).collect() == []
    assert [r.verdict for r in U.judge(pages(spark, [(1, "http://x.org/a")]), "page_id", "url", labels(spark, []), []).collect()] == ["allow"]


def sample(n=400):
    rng, rows, bad = random.Random(5), [], []
    for i in range(n):
        host = rng.choice(["www.good.org", "m.good.org", "spam.farm.org", "www.spam.org", "hot.org", "hot.org", "hot.org"])
        url = f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'es', 'buy'])}/{rng.randrange(9)}{rng.choice(['', '.html'])}{rng.choice(['', '?ref=1', '#top'])}"
        rows.append((i, url))
        if i % 3:
            p = 0.9 if host == "spam.farm.org" else 0.8 if host == "hot.org" and "/buy/" in url else 0.1
            bad.append((i, rng.random() < p))
    return rows, bad + [bad[0], (bad[1][0], True), (None, True)]


def brute(items, bad, min_rows, min_support, min_confidence):
    """Passing sets of tokens, found by counting all subsets of every transaction."""
    flag = {}
    for i, b in bad:
        if i is not None:
            flag[i] = flag.get(i, False) or b
    known = [(items[i], b) for i, b in flag.items() if items.get(i)]
    count = {}
    for t, b in known:
        for k in range(1, len(t) + 1):
            for s in combinations(t, k):
                n, m = count.get(s, (0, 0))
                count[s] = (n + 1, m + b)
    return {s: c for s, c in count.items() if c[1] >= min_rows and c[1] >= min_support * len(known) and c[1] >= min_confidence * c[0]}


@pytest.mark.parametrize("min_rows,min_support,min_confidence", [(5, 0.01, 0.6), (3, 0.1, 0.3), (10_000, 0.01, 0.5)])
def test_mined_rules(spark, min_rows, min_support, min_confidence):
    rows, bad = sample()
    df = pages(spark, rows)
    p = U.parts("url")
    items = {r.page_id: tuple(r.t) for r in df.select("page_id", U.tokens("url", p["host"], p["path"]).alias("t")).collect()}
    assert all(list(t) == sorted(set(t)) and len(t) <= 8 for t in items.values())
    want = brute(items, bad, min_rows, min_support, min_confidence)
    flag = labels(spark, bad).groupBy("id").agg(F.bool_or("bad").alias("bad"))
    tok = spark.createDataFrame([(i, list(t)) for i, t in items.items()], "id long, items array<string>")
    mined = U.mine(tok.join(flag, "id").select("items", "bad"), Scratch(spark, "test-urls"), min_rows, min_support, min_confidence)
    assert {tuple(r["items"]): (r.rows, r.n_bad) for r in mined.collect()} == want
    least = {tuple(r["items"]) for r in U.minimal(mined).collect()}
    assert least == {s for s in want if not any(set(o) < set(s) for o in want)}
    got = {r.page_id: r.verdict for r in U.judge(df, "page_id", "url", labels(spark, bad), [], min_rows=min_rows, min_support=min_support,
                                                 min_confidence=min_confidence).collect()}
    assert got == {i: "block" if any(set(s) <= set(t) for s in want) else "allow" for i, t in items.items()}


def test_query_against_sql(spark):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(ORACLES["op12_url_rules"])
    rows = QUERIES["op12_url_rules"](spark, sf).select(*want.columns).collect()
    order = lambda r: [(x is not None, x) for x in r]
    assert sorted(map(tuple, rows), key=order) == sorted(want.fetchall(), key=order)


def test_sql_mines_the_same_rules(spark, tmp_path):
    rows, bad = sample(1500)
    con = duckdb.connect()
    spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    lab = [(i, 1, int(b)) for i, b in bad] + [(0, None, None), (3, 0, 0)]
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_url_rules"]).fetchall()
    got = [tuple(r) for r in QUERIES["op12_url_rules"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[4] for r in got} == {"allow", "block"}
