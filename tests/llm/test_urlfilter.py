"""Operator 2: brute force, SQL, edges."""

import datetime as dt
import random

import duckdb

from reportlake.llm import urlfilter

DAY = dt.date(2024, 1, 1)


def _keys(url):
    low = (url or "").lower()
    if "://" not in low:
        return []
    rest = low.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0]
    path = [s for s in rest[len(rest.split("/")[0]) :].split("?")[0].split("#")[0].split("/") if s]
    if not host:
        return []
    labels = host.split(".")
    out = [("host", host)] + [("domain", ".".join(labels[i:])) for i in range(len(labels))]
    out += [("word", w) for w in host.replace("-", ".").split(".") if w]
    return out + [("path", host + "/" + "/".join(path[: i + 1])) for i in range(len(path))]


def _brute(captures, entries):
    strict = {"deny": 2, "allow": 1, "remove": 0}
    log = {}
    for kind, key, state, day in entries:
        if None not in (kind, key, day) and state in strict:
            days = log.setdefault((kind, key), {})
            days[day] = max(days.get(day, 0), strict[state])
    out = []
    for page, url, day in captures:
        best = None
        for kind, key in _keys(url) if day else []:
            held = [d for d in log.get((kind, key), {}) if d <= day]
            state = log[kind, key][max(held)] if held else 0
            if state:
                found = (urlfilter.KINDS.index(kind), len(key), state, key, kind, max(held))
                best = max(best, found) if best else found
        out.append((page, url, day, {2: "deny", 1: "allow"}[best[2]] if best else "none", *((best[4], best[3], best[5]) if best else (None, None, None))))
    return out


def test_equals_brute_force(spark):
    r = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "best-bets.example.org", "x.y.z.example.org", "example.com"]
    paths = ["", "/", "/en", "/en/1?x=2", "/fr/2/3#t", "/en/1/2/3"]
    day = lambda n: DAY + dt.timedelta(days=n)
    captures = [(i, r.choice(["http", "HTTPS"]) + "://" + r.choice(["", "u@"]) + r.choice(hosts).title() + r.choice(["", ":80"]) + r.choice(paths), day(r.randrange(90))) for i in range(300)]
    captures += [(400, None, DAY), (401, "no url", DAY), (402, "http://a.example.com/", None), (None, "http://a.example.com/en", day(9)), (1, "http://a.example.com/en", day(3)), (1, "http://a.example.com/en", day(3))]
    keys = sorted({k for _, u, _ in captures for k in _keys(u)})
    entries = [(*r.choice(keys), r.choice(["deny", "allow", "remove"]), day(r.randrange(-10, 95))) for _ in range(250)]
    entries += [(None, "x", "deny", DAY), ("host", None, "deny", DAY), ("host", "a.example.com", "deny", None), ("host", "a.example.com", "odd", DAY)]
    c = spark.createDataFrame(captures, "page_id long, url string, day date")
    e = spark.createDataFrame(entries, "kind string, key string, state string, day date")
    got = urlfilter.url_filter(c.selectExpr("*", "1 as month", "'v' as verdict", "'k' as kind"), e.selectExpr("*", "1 as valid_to")).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(_brute(captures, entries), key=key)
    assert urlfilter.url_filter(c.where("false"), e).collect() == []
    assert {x.verdict for x in urlfilter.url_filter(c, e.where("false")).collect()} == {"none"}


def test_registered_query_over_many_days(spark):
    pages = spark.createDataFrame([(i * 7, f"https://{h}.example.{t}/{p}/{i}") for i, (h, t, p) in enumerate([("m.a", "com", "en"), ("free-bets", "org", "de"), ("www.c", "net", "fr")] * 70)] + [(9999, None)], "page_id long, url string")
    c = urlfilter.page_captures(pages)
    got = {tuple(r) for r in urlfilter.url_filter(c, urlfilter.page_entries(c)).collect()}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert got == set(con.execute(urlfilter.SQL).fetchall())
    assert {r[3] for r in got} == {"deny", "allow", "none"}
