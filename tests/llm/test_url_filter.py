import datetime as dt
import random

from fathom.llm.url_filter import intervals, url_filter

LIST = "list string, kind string, value string, verdict string, dated string, active boolean, url string"
CAPTURES = "page_id bigint, url string, fetched string, value string, kind string"


def day(n):
    return str(dt.date(2024, 1, 1) + dt.timedelta(n))


def run(frame, captures, entries):
    rows = url_filter(frame([(*c, "clash", "clash") for c in captures], CAPTURES),
                      frame([(*e, "clash") for e in entries], LIST)).collect()
    return sorted((r.id if r.id is not None else -1, r.blocked, r.n_active, r.decided_by) for r in rows)


def test_intervals(frame):
    events = [("l", "host", "a.b", "block", day(d), on, None) for d, on in
              [(0, True), (5, False), (5, False), (9, True), (9, False), (12, True)]] + [("l", "host", "c", None, None, True, None),
                                                                                        (None, "host", "c", None, day(1), True, None)]
    got = sorted((r.value, str(r.start), r.until and str(r.until), r.verdict) for r in intervals(frame(events, LIST)).collect())
    assert got == [("a.b", day(0), day(5), "block"), ("a.b", day(9), day(12), "block"), ("a.b", day(12), None, "block"),
                   ("c", "0001-01-01", None, "block")]


def test_precedence_and_defined_cases(frame):
    entries = [("l", "domain", "x.com", "block", day(0), True), ("l", "host", "a.x.com", "allow", day(0), True),
               ("l", "prefix", "a.x.com/p/q", "block", day(0), True), ("m", "prefix", "a.x.com/p/q", "allow", day(0), True)]
    captures = [(1, "http://b.x.com/", day(1)), (2, "HTTPS://u:p@A.x.com:80/p", day(1)), (3, "//a.x.com/p/q/r?x#y", day(1)),
                (4, "http://a.x.com/p/qq", day(1)), (5, None, day(1)), (6, "not a url", day(1)), (7, "http://x.com", None),
                (8, "http://x.com", "2023-12-31"), (None, "http://yx.com./", day(1)), (9, "http://x.com.", day(1)), (9, "http://x.com.", day(1)),
                (10, "http://a.x.com/" + "z/" * 50_000, day(1))]
    assert run(frame, captures, entries) == [
        (-1, False, 0, None), (1, True, 1, "l:domain:x.com"), (2, False, 2, "l:host:a.x.com"), (3, True, 4, "l:prefix:a.x.com/p/q"),
        (4, False, 2, "l:host:a.x.com"), (5, False, 0, None), (6, False, 0, None), (7, False, 0, None), (8, False, 0, None),
        (9, True, 1, "l:domain:x.com"), (9, True, 1, "l:domain:x.com"), (10, False, 2, "l:host:a.x.com")]
    assert run(frame, captures[:1], []) == [(1, False, 0, None)] and run(frame, [], entries) == []


def test_against_brute_force(frame):
    draw = random.Random(3)
    hosts = [f"{a}.{b}.org" for a in "abc" for b in "xyz"]
    entries = []
    for kind, value in {(k, v) for h in hosts for k, v in (("host", h), ("domain", h[2:]), ("domain", "org"), ("prefix", h + "/1"), ("prefix", h + "/1/2"))}:
        for _ in range(draw.randrange(4)):
            entries.append(("l", kind, value, draw.choice(["block", "allow"]), day(draw.randrange(40)), draw.random() < 0.6))
    captures = [(i, f"http://{draw.choice(hosts)}/" + draw.choice(["", "1", "1/2", "12", "1/2/3"]), day(draw.randrange(50))) for i in range(300)]

    def expected(url, fetched):
        host, _, path = url[7:].partition("/")
        state = {}
        for ls, kind, value, verdict, dated, on in sorted(entries, key=lambda e: (e[4], e[5], e[3] == "block")):
            if dated <= fetched:
                state[ls, kind, value] = verdict if on else None
        hits = [(["domain", "host", "prefix"].index(k), len(v), verdict == "block", f"{ls}:{k}:{v}") for (ls, k, v), verdict in state.items() if verdict and (
            v == host if k == "host" else (host == v or host.endswith("." + v)) if k == "domain" else (host + "/" + path + "/").startswith(v + "/"))]
        top = max(hits, default=(0, 0, False, None))
        return top[2], len(hits), top[3]
    assert run(frame, captures, entries) == sorted((i, *expected(u, f)) for i, u, f in captures)


def test_a_later_verdict_ends_the_earlier(frame):
    entries = [("l", "host", "a.b", "block", day(0), True), ("l", "host", "a.b", "allow", day(60), True), ("l", "host", "a.b", "block", day(90), True)]
    captures = [(i, "http://a.b/", day(d)) for i, d in enumerate((10, 70, 100))]
    assert run(frame, captures, entries) == [(0, True, 1, "l:host:a.b"), (1, False, 1, "l:host:a.b"), (2, True, 1, "l:host:a.b")]
    same = [("l", "host", "a.b", v, day(0), on) for v, on in (("allow", True), ("block", True), ("block", False))]
    assert run(frame, captures[:1], same) == [(0, True, 1, "l:host:a.b")]
