"""URL templates against the same rules in plain Python, and the cases a cap would decide otherwise."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from riskframe.llm import url_templates
from riskframe.llm.url_templates import ALIKE, FEW, PRIOR, PURITY, SUPPORT

SCHEMA = "page_id bigint, url string"


def brute(paths):
    """(host, shape) -> rejected, from the whole tree without stopping early. ``paths``: (host, shape, n, n_block, n_labelled)."""
    everything = (sum(p[3] for p in paths) + 1) / (sum(p[2] for p in paths) + 2)
    out = {}

    def judge(rows, above):
        n, b, known = (sum(r[i] for r in rows) for i in (2, 3, 4))
        share = (b + PRIOR * above) / (n + PRIOR)
        return share, known >= SUPPORT and share >= PURITY

    def walk(rows, level, above):
        share, verdict = judge(rows, above)
        branches = defaultdict(list)
        for r in rows:
            branches[r[1][level] if level < len(r[1]) else ""].append(r)
        all_b, all_known = sum(r[3] for r in rows), sum(r[4] for r in rows)
        groups = defaultdict(list)
        for name, members in branches.items():
            n, b, known = (sum(r[i] for r in members) for i in (2, 3, 4))
            others = all_known - known
            if name == "":
                key = ("end", "")
            elif known and others and abs(b / known - (all_b - b) / others) > ALIKE * math.sqrt(
                all_b / all_known * (1 - all_b / all_known) * (1 / known + 1 / others)
            ):
                key = ("own", name)
            elif n <= FEW:
                key = ("rare", "")
            else:
                key = ("merged", "") if known and others else ("own", name)
            groups[key] += members
        for (kind, _), members in groups.items():
            if kind == "end":
                for r in members:
                    out[(r[0], tuple(r[1]))] = judge(members, share)[1]
            else:
                walk(members, level + 1, share)

    hosts = defaultdict(list)
    for p in paths:
        hosts[p[0]].append(p)
    for rows in hosts.values():
        walk(rows, 0, everything)
    return out


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    return {urls[r.page_id]: r for r in url_templates.judge_urls(pages, rules).collect()}


def test_templates_are_those_of_the_whole_tree(spark):
    pick = random.Random(8)
    found = {}
    for _ in range(500):
        host = pick.choice("aab")
        depth = pick.randrange(0, 5)
        shape = tuple(pick.choice(["x", "y", "z", "*", f"s{pick.randrange(30)}q"]) for _ in range(depth))
        n = pick.choice([1, 1, 2, 3, 9])
        known = pick.choice([0, n, pick.randrange(n + 1)])
        blocked = known if (shape[:1] == ("x",) or pick.random() < 0.1) else 0
        found[(host, shape)] = (host, list(shape), n, blocked, known)
    paths = spark.createDataFrame(list(found.values()), "host string, shape array<string>, n bigint, n_block bigint, n_labelled bigint")
    got = url_templates.templates(paths).collect()
    assert len(got) == len(found)
    expected = brute(list(found.values()))
    # Where every url is labelled the rule decides, so such a template need not be followed.
    open_ = {k for k, v in found.items() if v[4] < v[2]}
    assert {(r.host, tuple(r["shape"])): r.rejected for r in got if (r.host, tuple(r["shape"])) in open_} == {k: expected[k] for k in open_}
    assert any(expected[k] for k in open_) and not all(expected[k] for k in open_)


def test_verdicts_do_not_turn_with_the_number_of_siblings(spark):
    rules = (("block", "h.com", "/de/"),)
    for siblings in (5, 49, 50, 51, 200):
        urls = [f"http://h.com/de/p{i}" for i in range(40)] + [f"http://h.com/{'abcdefgh'[i % 8]}{'k' * (i // 8)}/p{j}" for i in range(siblings) for j in range(4)]
        rows = judged(spark, urls, rules)
        assert {u for u, r in rows.items() if r.verdict == "block"} == set(urls[:40])


def test_deep_segments_count_and_unlabelled_urls_weigh(spark):
    deep = "http://h.com/a/b/c/d/e"
    rules = (("block", "h.com", "/a/b/c/d/e/bad/one"), ("allow", "h.com", "/a/b/c/d/e/good"))
    urls = [f"{deep}/bad/one{i}" for i in range(90)] + [f"{deep}/bad/two"] + [f"{deep}/good/{i}" for i in range(60)] + [f"{deep}/other/{i}" for i in range(9)]
    rows = judged(spark, urls, rules)
    assert rows[f"{deep}/bad/two"].verdict == "allow" and rows[f"{deep}/other/3"].verdict == "allow"
    # One value among 90 blocked ones of a variable segment is blocked; beside as many unlabelled values it is not.
    slugs = [f"http://h.com/shop/v{'ab'[i % 2] * (i + 1)}" for i in range(60)]
    rules = tuple(("block", "h.com", u.removeprefix("http://h.com")) for u in slugs[:50])
    few = judged(spark, [*slugs[:50], "http://h.com/shop/new"], rules)
    assert few["http://h.com/shop/new"].verdict == "block"
    many = judged(spark, [*slugs[:50], *[f"http://h.com/shop/w{'k' * i}" for i in range(50)]], rules)
    assert {r.verdict for u, r in many.items() if r.rule is None} == {"allow"}


def test_levels_decide_verdicts_under_the_given_rules(spark, monkeypatch):
    """A host of mostly blocked urls does not take others along, and a rule's place written another way is still found."""
    site = "http://www.example.com"
    german = [f"{site}/de/{i}" for i in range(95)]
    english, slashes = [f"{site}/en/{c}" for c in "abcde"], [f"{site}//de/{i}" for i in range(3)]
    hosts = [german + english, german + slashes + [f"{site}/en/{'k' * i}" for i in range(1, 60)]]

    def blocked():
        return [{u for u, r in judged(spark, urls, url_templates.RULES).items() if r.rule is None and r.verdict == "block"} for urls in hosts]

    assert blocked() == [set(), set(slashes)]
    monkeypatch.setattr(url_templates, "_undecided", lambda: F.lit(False))
    assert blocked() == [set(english), set()]


def test_odd_urls(spark):
    long = "http://h.com/" + "/".join("abc" for _ in range(5000))
    urls = [None, "", "no url", "http://", long, long, "http://h.com//x//"]
    pages = spark.createDataFrame([(i, u, "x", 3) for i, u in enumerate(urls)], SCHEMA + ", rule string, template int")
    rows = {r.page_id: r for r in url_templates.judge_urls(pages).collect()}
    assert len(rows) == len(urls) and {r.verdict for r in rows.values()} == {"allow"}
    assert rows[4].host == "h.com" and rows[4].path == rows[5].path and rows[6].path == "//x//"
    assert url_templates.judge_urls(pages.limit(0)).count() == 0
