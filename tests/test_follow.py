import random

from webloom.operators.follow import follow_links


def _walks(spark, urls, nexts, most):
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    nx = spark.createDataFrame(list(nexts.items()), "page_id long, next_url string")
    return sorted(tuple(r) for r in follow_links(pages, nx, most).collect())


def _brute(urls, nexts, most):
    key = lambda u: u.split("#")[0]                                                          # noqa: E731
    by_key = {}
    for i, u in sorted(urls.items(), reverse=True):
        by_key[key(u)] = i
    out = []
    for i, u in urls.items():
        seen, now = {key(u)}, u
        out.append((i, 0, u))
        for hop in range(1, most):
            now = nexts.get(by_key.get(key(now)))
            if now is None or key(now) in seen:
                break
            seen.add(key(now))
            out.append((i, hop, now))
    return sorted(out)


def test_random_pointers_with_cycles_and_dead_ends(spark):
    r = random.Random(6)
    urls = {i: f"https://h.example/{i}" for i in range(80)}
    urls[80] = "https://h.example/3#top"                     # a second page of one URL
    nexts = {i: r.choice([f"https://h.example/{r.randrange(95)}", f"https://h.example/{i + 1}", f"https://h.example/{i}#x", None]) for i in range(81)}
    for most in (1, 2, 3, 8, 33):
        assert _walks(spark, urls, nexts, most) == _brute(urls, nexts, most)


def test_a_long_chain(spark):
    urls = {i: f"https://h.example/{i}" for i in range(70)}
    nexts = {i: f"https://h.example/{(i + 1) % 70}" for i in range(70)}
    got = _walks(spark, urls, nexts, 1000)
    assert len(got) == 70 * 70 and max(h for _, h, _ in got) == 69
