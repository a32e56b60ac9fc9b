from datetime import date, timedelta

from pyspark.sql import functions as F

from lociforge.llm import urlfilter

DAY = date(2024, 1, 1)
ENTRIES = [
    ("spam", "bad.example.org", DAY, True), ("spam", "bad.example.org", DAY + timedelta(10), False),
    ("spam", "bad.example.org", DAY + timedelta(300), True), ("adult", "example.org", DAY + timedelta(5), True),
    ("allow", "good.example.org", DAY, True), ("spam", "both.org", DAY, True), ("spam", "both.org", DAY, False),
    ("spam", None, DAY, True), ("spam", "x.org", None, True), ("spam", "UPPER.org", DAY, True), ("adult", "upper.org", DAY, True),
]


def brute(host, day):
    best = None
    labels = host.split(".")
    domains = [".".join(labels[i:]) for i in range(len(labels) - 1)] or ([host] if host else [])
    for domain in domains if day else []:
        active = set()
        for name in {e[0] for e in ENTRIES}:
            own = [e for e in ENTRIES if e[0] == name and (e[1] or "").lower() == domain and e[2] and e[2] <= day]
            if own:
                last = max(e[2] for e in own)
                if all(e[3] for e in own if e[2] == last):
                    active.add(name)
        if active and best is None:
            best = domain, ",".join(sorted(active))
    return (False, None, None) if best is None else ("allow" not in best[1].split(","), *best)


def test_verdicts_match_brute_force(llm):
    hosts = ["bad.example.org", "www.bad.example.org", "good.example.org", "example.org", "both.org", "upper.org", "localhost", "other.net"]
    rows = [(i * 100 + d, f"HTTP://user@{h.upper()}:80/p?q#f", DAY + timedelta(d)) for i, h in enumerate(hosts) for d in (-1, 0, 4, 5, 9, 10, 200, 299, 300, 700)]
    rows += [(9000, None, DAY), (9001, "not a url", DAY), (9002, "http://bad.example.org/", None), (0, rows[0][1], rows[0][2])]
    captures = llm.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, fetched_on date, domain string, _host string")
    entries = llm.createDataFrame(ENTRIES, "list string, domain string, day date, added boolean")
    found = urlfilter.verdicts(captures, entries)
    assert found.columns == ["page_id", "url", "fetched_on", "_host", "host", "blocked", "domain", "lists"]
    got = sorted((r.page_id, r.host, r.blocked, r.domain, r.lists) for r in found.collect())
    want = []
    for page, url, day in rows:
        host = url.lower().split("@")[1].split(":")[0] if url and "@" in url else "bad.example.org" if page == 9002 else ""
        want.append((page, host, *brute(host, day)))
    assert got == sorted(want)


def test_no_python_and_no_cross_join(llm):
    captures = llm.createDataFrame([(1, "http://a.org/", DAY)], "page_id long, url string, fetched_on date")
    entries = llm.createDataFrame(ENTRIES, "list string, domain string, day date, added boolean")
    plan = urlfilter.verdicts(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_tables(llm):
    captures = llm.createDataFrame([], "page_id long, url string, fetched_on date")
    entries = llm.createDataFrame(ENTRIES, "list string, domain string, day date, added boolean")
    assert urlfilter.verdicts(captures, entries).collect() == []
    one = llm.createDataFrame([(1, "http://a.org/", DAY)], "page_id long, url string, fetched_on date")
    assert [r.blocked for r in urlfilter.verdicts(one, entries.filter(F.lit(False))).collect()] == [False]


def test_hosts_and_domains_are_normalised(llm):
    forms = {
        "http://bad.org./x": "bad.org", "  http://bad.org/": "bad.org", "//bad.org/": "bad.org", "http:\\\\bad.org\\x": "bad.org",
        "http://[::1]:80/": "[::1]", "http://[::FFFF:1.2.3.4]/": "[::ffff:1.2.3.4]", "https://a@b@Bad.ORG:8/": "bad.org",
        "ht\ntp://ba\td.org": "bad.org", "http:///x": "", "bad.org/x": "", "http://": "", "http://1.2.3.4/": "1.2.3.4", "": "",
        "http://www.bad.org..?q": "www.bad.org", "http://bad.org#@good.org": "bad.org",
    }
    rows = llm.createDataFrame([(i, u, DAY) for i, u in enumerate(forms)], "page_id long, url string, fetched_on date")
    entries = llm.createDataFrame(
        [("spam", " *.BAD.org. ", DAY, True), ("spam", "3.4", DAY, True), ("adult", "[::1]", DAY, True)], "list string, domain string, day date, added boolean",
    )
    found = {r.url: r for r in urlfilter.verdicts(rows, entries).collect()}
    assert {u: r.host for u, r in found.items()} == forms
    assert {u for u, r in found.items() if r.blocked} == {u for u, h in forms.items() if h.endswith("bad.org") or h == "[::1]"}
