"""Links by their place, tries over addresses, and the judge of globs."""

from pyspark.sql import functions as F

from siftmill.operators import cards


def test_places_of_links():
    html = """<body><ul><li><a href="/a">1</a><li class="x2"><a href='/b'>2</a></ul><script>'<a href="/no">'</script><div class="k9 c"><a href=/c?d=1&amp;e=2>3<br></a></div></div>
      <!-- <a href="/no"> --><p>t<p><a title="a>b" HREF="/d">4</a><a name="n">5</a><table><tr><td><a href="/e">6</a><td><a href="/f">7</a><tr><td><a href="/g">8</a></table>"""
    found = list(cards.places(html))
    assert [h for h, _ in found] == ["/a", "/b", "/c?d=1&e=2", "/d", "/e", "/f", "/g"]
    assert [p for _, p in found] == ["body>ul>li>a", "body>ul>li.x0>a", "body>div.c.k0>a", "body>p>a", "body>p>table>tr>td>a", "body>p>table>tr>td>a", "body>p>table>tr>td>a"]
    assert list(cards.places("")) == []


def test_from_a_list_page_to_a_judged_glob(spark):
    items = "".join(f'<div class="card{k}"><a href="/jobs/{city}/{k}?ref=1">x</a></div>' for k, city in enumerate(["berlin", "paris", "rome", "oslo", "berlin"]))
    html = f'<nav><a href="/en/home">h</a><a href="/en/help">h</a><a href="/en/us">h</a></nav>{items}<footer><a href="/imprint">i</a></footer>'
    pages = spark.createDataFrame([("s", "https://s.com/list", html), ("s", "https://s.com/list2", None), ("t", "https://t.com", "<a href='/x'>")], "site string, url string, html string")
    urls = spark.createDataFrame([("s", f"https://s.com/jobs/{c}/{k}#f", True) for c in ("berlin", "wien") for k in range(3)] + [("s", "https://s.com/en/help", False), ("s", "https://s.com/en/a/b", False)], "site string, url string, candidate boolean")
    got = sorted(map(tuple, cards.discovered(pages, urls, "site").collect()))
    assert got == [("s", "**/en/*", 3, 1, 1, False), ("s", "**/jobs/*/*", 5, 6, 0, True)]
    assert cards.discovered(pages.filter("false"), urls, "site").count() == 0


def test_a_name_that_nearly_all_share_is_kept(spark):
    links = spark.createDataFrame([("k", 1, f"https://h/{'jobs' if k else 'work'}/{k}") for k in range(20)] + [("k", 2, f"https://h/a{k}/b") for k in range(5)], "site string, place long, href string")
    got = [tuple(r) for r in cards.globs_of(links, ["site"]).collect()]
    assert got == [("k", "**/jobs/*", 20)]
    loose = cards.globs_of(links.withColumn("href", F.regexp_replace("href", "/jobs/([0-9])$", "/w$1/$1")), ["site"])
    assert [r["glob"] for r in loose.collect()] == ["**/*/*"]
