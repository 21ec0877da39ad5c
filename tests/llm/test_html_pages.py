"""Pages against expected text, hostile pages against the clock, and visible words against a second, plain reader."""

import time
from html.parser import HTMLParser

import pytest
from chronospark.llm import html

PAGES = [
    ("a<br>b", "a\nb"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol start=4><li>a<li>b<ul><li>c</ul></ol>", "4. a\n5. b\n   - c"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("<textarea>\nx\n y</textarea>", "x\n y"),
    ("<select><option>r<option selected>g</select>", "r\ng"),
    ("<svg><g><text>one</text><text>two</text></g></svg>", "one two"),
    ("a <span aria-hidden=true>b</span>", "a b"),
    ("a <span hidden>b</span><i style='display:none'>c</i>", "a"),
    ("<p style='visibility: hidden'>no</p>yes", "yes"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide     x\na     b  c"),
    ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "a     b\n      c\nd  e  f"),
    ("<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>", "a     b\n\ni  j"),
    ("<table><caption>cap</caption><thead><tr><th>h</thead><tbody><tr><td>v</table>", "cap\nh\nv"),
    ("x<script>if (a < b) {}</script>y<style>p>a{}</style>z", "xyz"),
    ("<noscript>no</noscript><template>no</template>yes", "yes"),
    ("&lt;b&gt; &amp; &eacute;&#33;", "<b> & é!"),
    ("a<!-- x > y -->b<!doctype html>c", "abc"),
    ("<a href='x>y'>t</a>", "t"),
    ("<p class=don't>it's</p>", "it's"),
    ("<h1>a</h1>b<hr>c", "a\n\nb\n--------------------\nc"),
    ("<img alt='pic' src=x> <input value=v><input type=hidden value=no>", "pic v"),
    ("<object data=x>fall</object><iframe>no</iframe>", "fall"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"),
    ("a   b\n\tc", "a b c"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<td>loose<td>cells", "loose cells"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
]


@pytest.mark.parametrize(("source", "want"), PAGES)
def test_pages(source, want):
    assert html.render(source)[1] == want


HOSTILE = ["<a ", "<a '", "<a =\"", "<!--", "<!", "<b>", "<div>", "<ul><li>", "<blockquote>", "<table><tr><td>", "<x></y>", "</p>", "<p><table>", "&", "<", ">", "<a href='>", "<td colspan=1000>x", "<svg>", "<option>", "x<br>", "<li>a", "<title>", "<a b=c d ", "<tr><td rowspan=9 colspan=999>"]


@pytest.mark.parametrize("part", HOSTILE)
@pytest.mark.parametrize("end", ["", ">", "x</x>\"'>"])
def test_time_grows_with_length_only(part, end):
    source = "<x><table><td>" + part * (300_000 // len(part)) + end
    began = time.perf_counter()
    html.render(source)
    assert time.perf_counter() - began < 8


class Plain(HTMLParser):
    """Words outside of elements that never show."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "noscript", "template")

    def handle_data(self, data):
        self.words += [] if self.hidden > 0 else data.split()


def test_all_words_of_real_pages_are_there(spark, small):
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect() if r["html"]]
    kept = 0
    for page in pages:
        reader = Plain()
        reader.feed(page)
        got = "".join(html.render(page)[1].split())
        assert all(w in got for w in reader.words)
        kept += len(reader.words)
    assert kept > 1000
