"""Addresses against the standard library's own resolution and parser."""

from __future__ import annotations

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tessera.functions import addresses as W
from tessera.operators import documents as D

BASES = ["https://h.org/a/b/page.html", "https://h.org", "https://h.org/", "http://h.org/x//y/?q=1#f", "https://H.org:8443/dir/?a=/b/../c", "https://h.org/a/./b/../"]
KNOWN = ["", "#t", "?q=1", "x", "./x", "../x", "../../../x", "/x/../y", "//o.org/z", "HTTPS://o.org/Q", "JavaScript:void(0)", "mailto:a@b.c", "..", ".", "a/./b/../c/", " /trim ", "/a b", "https:rel", "x?y#z", "//", "a//b", "?", "../.", "x/..", "tel:1", "/..", "https://h.org"]


def test_resolution(spark):
    r = random.Random(1)
    parts = ["a", "b.pdf", "..", ".", "", "?x=1&y=2", "#f", "..x", "%20", "é"]
    pairs = [(b, k) for b in BASES for k in KNOWN] + [(r.choice(BASES), "/".join(r.choice(parts) for _ in range(r.randrange(1, 6)))) for _ in range(600)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, base string, href string")
    got = {x.i: x.link for x in rows.select("i", W.resolved(F.col("base"), F.col("href")).alias("link")).collect()}
    assert [(p, got[i]) for i, p in enumerate(pairs)] == [(p, urljoin(*p)) for p in pairs]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = [dict(attrs).get("href"), []]
            self.found.append(self.open)

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open[1].append(data.strip())


def plain_links(base, html):
    p, seen = Anchors(), {}
    p.feed(html)
    p.close()
    for n, (href, texts) in enumerate(p.found):
        if not href or href.startswith(("javascript:", "#")):
            continue
        link = urljoin(base, href)
        if link.startswith("https") and link not in seen:
            seen[link] = (n, "".join(texts))
    return {(k, *v) for k, v in seen.items()}


PIECES = [
    '<a href="/a.pdf?x=1&amp;y=2">One &lt; two</a>', "<a href=up.pdf>bare</a>", "<a HREF='../up.pdf'>Up <b>x</b> </a>", '<a data-href="/no.pdf" href="/yes.pdf">d</a>', '<a data-href="/no2.pdf">none</a>',
    '<a href="?q=1">query</a>', '<a href="HTTPS://o.org/Case">big</a>', '<a href="JavaScript:void(0)">js</a>', '<a href="javascript:x()">js</a>', '<a href="#t">t</a>', '<a href="http://o.org/c">plain</a>',
    "<abbr href='/abbr'>no</abbr>", "<!-- <a href='/comment'>no</a> -->", "<script>var a = '<a href=\"/script\">no</a>';</script>", '<a title="1 > 0" href="/quoted">q</a>', '<a\n href = "/space" >s\n</a>',
    '<a href="/open">open <a href="/next">next</a>', "<p>text</p>", '<a href="">empty</a>', "<a>no</a>", '<a href="/a.pdf?x=1&amp;y=2">again</a>', '<a title="href=/title" href="/é?ü=1">u</a>', '<style>a { content: "<a href=/style>" }</style>',
]


def test_links_of_pages(spark):
    r = random.Random(4)
    pages = [(i, r.choice(BASES), "".join(r.choice(PIECES) for _ in range(r.randrange(1, 12)))) for i in range(150)] + [(900 + i, BASES[0], p) for i, p in enumerate(PIECES)]
    rows = spark.createDataFrame(pages + [(1000, BASES[0], None), (1001, BASES[0], "")], "k long, u string, h string")
    got = {}
    for x in D.links(rows, "k", "u", "h").collect():
        got.setdefault(x.k, set()).add((x.link, x.ord, x.label))
    for k, base, html in pages:
        assert got.get(k, set()) == plain_links(base, html), html
    assert not {1000, 1001} & set(got)


def test_mined_addresses(spark):
    html = """<button onclick="window.open('/static/file.pdf?a=1&amp;b=2')">x</button><img src=../logo.png><div data-file="./d.pdf" data-other="/no.pdf"></div>
    <script src="/s.js">open('/inside.pdf')</script><!-- <a href="/c.pdf"></a> --><a href="https://other.org/x.pdf">o</a><a href='https://www.h.org/y.pdf'>y</a><input value="/v 1"><input VALUE=' /v2 '>"""
    rows = spark.createDataFrame([(1, "https://www.h.org/dir/page", html)], "k long, u string, h string")
    got = {x.link: (x.context, x.ord) for x in D.mined_addresses(rows, "k", "u", "h").collect()}
    # Inside "./d.pdf" there also is what looks like an address of its own, "/d.pdf".
    assert set(got) == {"https://www.h.org/d.pdf", "https://www.h.org/static/file.pdf?a=1&b=2", "https://www.h.org/logo.png", "https://www.h.org/dir/d.pdf", "https://www.h.org/s.js", "https://www.h.org/y.pdf", "https://www.h.org/v2"}
    assert got["https://www.h.org/static/file.pdf?a=1&b=2"] == ("window.open('/static/file.pdf?a=1&b=2')", 0) and got["https://www.h.org/v2"][1] == 6
