import random
from collections import deque

import pytest

from docquarry.operators import crawl, links
from docquarry.operators.numbering import running_totals
from pyspark.sql import functions as F


def simulate(base, pages, domain_of, wanted, max_pages, max_depth):
    """One page at a time: ``pages`` maps a URL that can be fetched to its links."""
    waiting, waiting_set, visited, stored = deque([(base, 0)]), {base}, set(), []
    found = added = filtered = 0
    home = domain_of(base)
    while waiting:
        url, depth = waiting.popleft()
        waiting_set.discard(url)
        if depth > max_depth or url in visited:
            continue
        if len(stored) >= max_pages:
            break
        visited.add(url)
        if (depth and not wanted(url)) or url not in pages:
            continue
        stored.append((url, depth))
        for target in pages[url]:
            found += 1
            if domain_of(target) not in ("", home):
                filtered += 1
            elif target in visited:
                pass
            elif depth and not wanted(target):
                filtered += 1
            elif target not in waiting_set:
                waiting.append((target, depth + 1))
                waiting_set.add(target)
                added += 1
    return stored, (len(stored), found, added, filtered, len(visited))


def random_site(rng, number):
    """A random site: wanted, unwanted and failing pages, foreign links, repeats and cycles."""
    host = f"https://s{number}.org"
    size = rng.randint(1, 45)
    names = [f"{host}/{rng.choice(['', '', 'blog/'])}n{i}" for i in range(size)]
    pool = names + [f"https://off{number}.org/x", "mailto://x@y", "file:///z", f"{host}/"]
    failing = {name for name in names[1:] if rng.random() < 0.2}
    pages = {
        name: [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        for name in names if name not in failing
    }
    return names[0], pages


def domain_of(url):
    return url.split("//", 1)[1].split("/", 1)[0]


def wanted(url):
    return url.startswith("https://s") and "blog" not in url and domain_of(url) + "/" != url[8:]


@pytest.mark.parametrize("max_pages, max_depth", [(200, 5), (12, 5), (5, 2), (1, 0), (200, 0), (0, 3)])
def test_equals_one_page_at_a_time(spark, max_pages, max_depth):
    rng = random.Random(max_pages * 100 + max_depth)
    sites = {f"p{n}": random_site(rng, n) for n in range(150)}
    projects = spark.createDataFrame([(p, base) for p, (base, _) in sites.items()],
                                     "project string, base_url string")
    edges = spark.createDataFrame(
        [(u, i, t) for _, pages in sites.values() for u, ts in pages.items() for i, t in enumerate(ts)],
        "src_url string, pos int, dst_url string")
    fetched = spark.createDataFrame([(u,) for _, pages in sites.values() for u in pages], "url string")
    walk = crawl.crawl(projects, edges, fetched, max_pages, max_depth, span=3)
    got = {}
    for row in walk.pages().collect():
        got.setdefault(row.project, []).append((row.page_rank, row.url, row.depth))
    counters = {row.project: tuple(row)[1:] for row in walk.summary().collect()}
    for project, (base, pages) in sites.items():
        stored, numbers = simulate(base, pages, domain_of, wanted, max_pages, max_depth)
        assert [(u, d) for _, u, d in sorted(got.get(project, []))] == stored, project
        assert [rank for rank, _, _ in sorted(got.get(project, []))] == list(range(len(stored)))
        assert counters[project] == numbers, project


def test_base_is_taken_as_given_and_always(spark):
    projects = spark.createDataFrame([("p", "https://d.com/blog#top")], "project string, base_url string")
    edges = spark.createDataFrame([("https://d.com/blog#top", 0, "https://d.com/blog"),
                                   ("https://d.com/blog#top", 1, "https://d.com/a")],
                                  "src_url string, pos int, dst_url string")
    fetched = spark.createDataFrame([("https://d.com/blog#top",), ("https://d.com/blog",),
                                     ("https://d.com/a",)], "url string")
    queue = {r.url: r.status for r in crawl.crawl(projects, edges, fetched).queue.collect()}
    assert queue == {"https://d.com/blog#top": "stored", "https://d.com/blog": "irrelevant",
                     "https://d.com/a": "stored"}


def test_malformed_link_loses_only_itself(spark):
    pages = spark.createDataFrame([("https://d.com/x", '<a href="http://[bad/"><a href="/ok">')],
                                  "url string, html string")
    assert [r.dst_url for r in links.page_links(pages).collect()] == ["https://d.com/ok"]


def test_running_totals_match_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(g, a, b, rng.randint(0, 5)) for g, n in (("x", 300), ("y", 1), ("z", 17))
            for a in range(n) for b in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "g string, a long, b int, v int")
    out = running_totals(df, ["g"], ["a", "b"], {"n": F.lit(1), "s": F.col("v")}, span=7).collect()
    for group in "xyz":
        count = total = 0
        for row in sorted((r for r in out if r.g == group), key=lambda r: (r.a, r.b)):
            assert (row.n, row.s) == (count, total)
            count, total = count + 1, total + row.v
