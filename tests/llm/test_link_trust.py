"""Propagation against dense matrices on a small web, and edge cases."""

import random

import numpy as np

from sparkfeat.llm import link_trust as lt


def brute(pages, rounds):
    import re

    host = lambda u: (re.match(lt.HOST, (u or "").strip().lower()) or [None, ""])[1].rstrip(".")
    hosts, edges = set(), []
    for _, u, h in pages:
        s = host(u)
        if s:
            hosts.add(s)
            for x in re.findall(lt.LINK, h or ""):
                d = host(x)
                if d:
                    hosts.add(d)
                    if d != s:
                        edges.append((s, d))
    names = sorted(hosts)
    at = {h: k for k, h in enumerate(names)}
    ends = lambda h, ss: any(h == s or h.endswith("." + s) for s in ss)
    out = {}
    for side in ("trust", "distrust"):
        a = np.zeros((len(names), len(names)))
        for s, d in edges:
            i, j = (at[s], at[d]) if side == "trust" else (at[d], at[s])
            a[j, i] += 1
        total = a.sum(axis=0)
        a = a / np.where(total > 0, total, 1)
        s = np.array([float(ends(h, lt.BLOCKED) if side == "distrust" else ends(h, lt.TRUSTED) and not ends(h, lt.BLOCKED)) for h in names])
        s = s / max(s.sum(), 1)
        r = s
        for _ in range(rounds):
            r = (1 - lt.DAMPING) * s + lt.DAMPING * (a @ r + r[total == 0].sum() * s)
        out[side] = dict(zip(names, r))
    return out


def test_ranks(spark):
    r = random.Random(2)
    hosts = [f"h{k}.{t}" for k in range(12) for t in ("example.org", "example.net", "example.com")]
    pages = []
    for k in range(80):
        links = "".join(f'<a class=x href="{r.choice(["http://", "//", "https://u@www."])}{r.choice(hosts)}/p?q">t</a><a href="/in">i</a>' for _ in range(r.randrange(4)))
        pages.append((k, f"https://{r.choice(hosts)}:80/{k}", links))
    pages += [(None, None, None), (90, "no host", "<a href='http://h1.example.com'>"), (91, "http://alone.example.com.", None), (91, "http://alone.example.com.", None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, trust string")
    want = brute(pages, 6)
    got = {x.host: x for x in lt.propagate(df, rounds=6).collect()}
    assert set(got) == set(want["trust"])
    for h, x in got.items():
        assert abs(x.trust - want["trust"][h]) < 1e-12 and abs(x.distrust - want["distrust"][h]) < 1e-12
    rows = lt.judged(df, rounds=6).collect()
    assert len(rows) == len(pages)
    assert all(x.blocked == int(x.host is not None and want["distrust"][x.host] > want["trust"][x.host] and want["distrust"][x.host] * len(got) >= lt.CUT) for x in rows)
    assert any(x.blocked for x in rows) and not all(x.blocked for x in rows)
    assert lt.judged(df.limit(0), rounds=2).count() == 0


def test_distrust_reaches_hosts_far_from_a_seed(spark, monkeypatch):
    monkeypatch.setattr(lt, "DAMPING", 0.5)  # of the brute force: fewer rounds to wait for
    chain = [f"c{k}.com" for k in range(30)] + ["example.net"]
    pages = [(k, f"http://{a}/", f"<a href='http://{b}/'>") for k, (a, b) in enumerate(zip(chain[:-1], chain[1:]))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = brute(pages, 200)["distrust"]
    got = {r.host: r.distrust for r in lt.propagate(df, damping=0.5).collect()}
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-10 and got[h] > 0 for h in want)


def test_long_and_broken_html_and_no_seeds(spark):
    many = "<a " * 200_000 + "x" * 200_000
    pages = [(1, "http://a.example.org/", many + "<a href='http://b.com/'>"), (2, "http://b.com/", "<p>" * 300_000), (3, "http://b.com/", "<a\nhref=//c.example.net/x>" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r for r in lt.propagate(df, rounds=8).collect()}
    assert set(got) == {"a.example.org", "b.com", "c.example.net"} and got["b.com"].trust > 0 and got["a.example.org"].distrust > 0
    none = lt.judged(df, trusted=(), blocked=()).collect()
    assert len(none) == 3 and all(r.trust == r.distrust == 0 and r.blocked == 0 for r in none)
