"""Pages and result pages against Python's own parser of HTML."""

import html
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.operators import retrieval as R

SKIPPED = ("script", "style", "nav", "footer")


class Page(HTMLParser):
    def __init__(self):
        super().__init__()
        self.pieces, self.off = [], False

    def handle_starttag(self, tag, attrs):
        self.off = self.off or tag in SKIPPED

    def handle_endtag(self, tag):
        self.off = self.off and tag not in SKIPPED

    def handle_data(self, data):
        if not self.off and data.strip():
            self.pieces.append(data.strip())


class Results(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.now, self.field = [], {}, None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "a" and "result__a" in (attrs.get("class") or ""):
            self.field, self.now["url"], self.now["title"] = "title", attrs.get("href") or "", ""
        elif tag == "a" and "result__snippet" in (attrs.get("class") or ""):
            self.field, self.now["snippet"] = "snippet", ""

    def handle_data(self, data):
        if self.field:
            self.now[self.field] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.field:
            if self.field == "snippet" and self.now.get("title") and self.now.get("url"):
                self.found.append((self.now["title"].strip(), self.now["url"], self.now["snippet"].strip()))
                self.now = {}
            self.field = None


def parsed(kind, text):
    p = kind()
    p.feed(text)
    p.close()
    return "\n".join(p.pieces) if kind is Page else p.found


TEXTS = ["it&#8217;s &mdash; caf&eacute; &#x1F600; &amp;amp; &lt;b&gt;", "&copy 2024 &notit; &notin; &hellip &nosuch; &nosuch & &; &# &#; &#x; &#xZ", "&#0; &#128; &#x93;q&#x94; &#xD800; &#1114112; &#99999999999; &#11; &#xFFFE;x &#13;", "&nbsp; a &nbsp;", "&NotEqualTilde;&nGt;&ThickSpace;x", "&AMP; &QUOT &lt &ltx &ampx; &times;&timesx", "no references", "&", "", "a&b;c", "&#065;&#x0041;&#x000041;"]


def test_references_as_python_reads_them(spark):
    rng = random.Random(1)
    names = [f"&{n}" for n in sorted(html.entities.html5)]
    texts = TEXTS + ["".join(names[i:i + 40]) for i in range(0, len(names), 40)] + [" ".join(rng.choice(names).rstrip(";") + rng.choice(["", ";", "x", "=", " ", "1;"]) for _ in range(30)) for _ in range(40)]
    texts += [f"&#{n};&#x{n:X}" for n in [*range(0, 0x200), 0xD7FF, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", H.unescape("t").alias("x")).collect()}
    assert got == {i: html.unescape(t) for i, t in enumerate(texts)}


PAGES = [
    "<p title='a > b' data-x=\"c > d\">one</p><br/>two<img alt=x>three", "<script>if (a < b) { x('</p>') }</script>kept<style>p > a {}</style> too", "<nav class='x > y'>menu<p>in</p></nav>out<footer>f</footer>end",
    "<!-- a > b -->x<!-- -- <p> -->z", "<!DOCTYPE html><?php echo ?>text", "a < b and c > d", "<p\nclass = 'multi\nline>' >t</p >", "<a href=x?y=1&amp;z>l</a>", "<p>&lt;b&gt; is &amp;lt;</p>", "<SCRIPT>no</SCRIPT>yes<Nav>no</nAV>yes",
    "<navigation>kept</navigation><scripted>also</scripted>", "<nav>a<script>b</script>c</nav>d", "<p>caf&eacute;&#8217;s</p><p> &nbsp; </p>", "<p>1</p>\n\n<p>2\n3</p>", "", "plain", "<p x='=' y=\"a='>'\">v</p>",
]


def test_page_text_as_python_parses_it(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", R.html_to_text("t").alias("x")).collect()}
    assert got == {i: parsed(Page, t) for i, t in enumerate(PAGES)}


def test_comments_as_the_standard_ends_them(spark):
    df = spark.createDataFrame([("<!-->x<!-- c --!>y<!--->z<!-- open <p>",)], "t string")
    assert df.select(R.html_to_text("t").alias("x")).first().x == "x\ny\nz"


def test_long_tags_do_not_overflow(spark):
    page = "<p " + " ".join(f"a{i}='x > {i}' b{i}=\"y\" c{i}=z" for i in range(20000)) + ">text</p>" + "&amp;" * 20000
    df = spark.createDataFrame([(page,)], "t string")
    assert df.select(R.html_to_text("t").alias("x")).first().x == "text\n" + "&" * 20000


def link(kind, href, text, quote='"'):
    return f"<a rel={quote}x{quote} class={quote}big {kind}{quote} href={quote}{href}{quote}>{text}</a>"


SERPS = [
    link("result__a", "http://x/?a=1&amp;b=2", "T &amp; <b>bold</b>") + link("result__snippet", "#", "S &#8217; <i>i</i>"),
    link("result__a", "http://x", "single", "'") + link("result__snippet", "#", "quotes", "'"),
    "<a class=result__a href=http://x/y>bare</a><a class=result__snippet>no target needed</a>",
    "<a href='http://x/result__a'>not a title</a>" + link("result__snippet", "#", "alone") + link("result__a", "u", "t1") + link("result__a", "v", "t2") + link("result__snippet", "#", "s2") + link("result__snippet", "#", "s3"),
    "<a title=\"class='result__a' href='no'\" class='result__a' href='yes'>t</a>" + link("result__snippet", "#", "s"),
    "<!-- " + link("result__a", "u", "hidden") + link("result__snippet", "#", "hidden") + " -->", link("result__a", "", "no target") + link("result__snippet", "#", "s"), "<A CLASS='result__a' HREF='u'>T</A><A Class='result__snippet'>S</A >",
    "<a class='result__a' href='u > v'>t</a><abbr class='result__a'>x</abbr><a class='result__snippet'>s</a>", "",
]


def test_results_as_python_parses_them(spark):
    df = spark.createDataFrame(list(enumerate(SERPS)), "i int, t string")
    got = {r.i: [tuple(x) for x in r.x] for r in df.select("i", R.serp_html_results("t").alias("x")).collect()}
    assert got == {i: parsed(Results, t) for i, t in enumerate(SERPS)}


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(H.unescape("t").alias("a"), R.html_to_text("t").alias("b"), R.serp_html_results(F.col("t")).alias("c")).first()
    assert row.a is None and not row.b and not row.c
