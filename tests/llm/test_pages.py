import base64
import hashlib
import random
from html.parser import HTMLParser

import pytest

from larkspur.llm import html_text, warc
from larkspur.llm.html_text import main_text

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a/ü\r\nX: y", None), (4, "u", ""), (None, "u", "<p>one</p>"), (5, "u", "é" * 30_000), (5, "u", "é" * 30_000),
    (6, "u", "a\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 9_000), (7, "u", "x" * 100), (0, "u", "x" * 100), (None, None, None),
]


def brute(pages, least=0):
    out = []
    for key, _, html in pages:
        payload = (html or "").encode()
        ids = [k for k, _, h in pages if (h or "").encode() == payload and k is not None]
        again = bool(ids) and len(payload) >= least and (key is None or key > min(ids))
        out.append((key, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 50])
def test_archive_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    assert sorted(map(tuple, warc.digests(pages, least).collect()), key=str) == brute(PAGES, least)
    assert warc.digests(pages.where("false")).collect() == []


def test_payloads_come_back(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write(pages, f"{tmp_path}/w", segment_bytes=1000)
    back = warc.read(spark, f"{tmp_path}/w").where("record_type = 'response'").collect()
    texts = {r.page_id: r.html for r in pages.collect()}
    assert len(back) > 40
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in back)


def test_missing_segment(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    warc.write(pages, f"{tmp_path}/w", segment_bytes=1000)
    records = warc.parsed(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{tmp_path}/w"))
    lost = warc.payloads(warc.reassembled(records.where("segment IS NULL OR segment != 3")), keep_payload=False).where("page_id = 6").collect()
    assert [r.payload_bytes for r in lost] == [None]


def test_chunks():
    for payload in (b"", b"a", b"x" * 20_000):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    assert warc.unchunked(b"3;name=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


HEAD = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li>More</ul></nav>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a &amp; b &lt;c&gt; &nbsp; d</p>", "a & b <c> d"),
        (HEAD + "<article><h1>Title</h1><p>Long text, with words.<p><b>Bold<br>next</b> end.<p>Short</article><footer>&copy; x</footer></body></html>", "Title\nLong text, with words.\nBold next end.\nShort"),
        (HEAD + "<div class='main-text'><p>One sentence, here.</p><p>Another one, there.</p></div><div class=sidebar><p>Links, and more links, and more.</p></div>", "One sentence, here.\nAnother one, there."),
        (HEAD + "<article><p>Text.</p><form><p>Send, please.</p></form><section id=comments><p>Nice, very nice text.</p></section><aside>x</aside><p hidden>no</p></article>", "Text."),
        (HEAD + "<article><p>Cut here &am", "Cut here &am"), (HEAD + "<article><p>Cut <b", "Cut"), ("<nav>only</nav>", ""), ("<article><p>a < b and c > d</article>", "a < b and c > d"),
        (HEAD + "<article><p>Tell <span class=ad>buy now</span>it.</p><!-- <p>no</p> --></article><div class=cookie-notice>We use cookies, many, many.</div>", "Tell it."),
        ("<article>loose <p>inner</p> tail</article>", "loose\ninner\ntail"),
        ("<p>Before</p><svg/><p>After</p>", "Before\nAfter"), ("<p>One <img src=x> two <button>Go</button>three <input>.</p>", "One two three ."),
        ("<article><section id='social-policy'><p>Text, here.</p></section><h2 id='search'>Find</h2><p>More <math><mi>x</mi></math>, <svg><g><path/><text>no</text></g></svg>end.</p></article>", "Text, here.\nFind\nMore x, end."),
        ("<article><p>Open <svg><path d=''> gone</p><p>Next, <select><option>a</select>text.</p></article>", "Open\nNext, text."),
        ("<article><p>One<title>two</p><p>three</p></article>", "One\ntwo\nthree"), ("<article><p>One</p><script>two</p><p>three</p></article>", "One"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


class Article(HTMLParser):
    """The text of the article element, read by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.out, self.now = 0, [], []

    def cut(self):
        if "".join(self.now).split():
            self.out.append(" ".join("".join(self.now).split()))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag == "br":
            self.now.append(" ")
        elif tag not in ("b", "i", "a", "em", "span"):
            self.cut()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "span"):
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    expected = {}
    for r in pages.collect():
        reader = Article()
        reader.feed(r.html)
        reader.close()
        reader.cut()
        expected[r.page_id] = (r.url, "\n".join(reader.out), len("\n".join(reader.out)))
    assert {r.page_id: tuple(r)[1:] for r in html_text.extracted(pages).collect()} == expected


def bare_page(rng):
    """A page without article, main, class or id, and its main text."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(9, 25))) + ", " + word() + "."
    body = [" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 8))]
    body.insert(0, word())
    links = "".join(f"<div><a href=/{i}>{word()} {word()} {word()}</a></div>" for i in range(rng.randint(150, 200)))
    side = "".join(f"<span><b>{word()} {word()}</b></span><hr>" for _ in range(rng.randint(20, 40)))
    main = f"<h1>{body[0]}</h1>" + "".join(f"<p>{p}" for p in body[1:])
    return f"<html><body><div>{links}</div><table><tr><td><div>{main}</div><td>{side}</table><div>{word()}</div></body></html>", "\n".join(body)


def test_articles_without_names():
    rng = random.Random(4)
    pages = [bare_page(rng) for _ in range(50)]
    assert [main_text(p) for p, _ in pages] == [t for _, t in pages]
    assert all(main_text(p, threshold=0) != t for p, t in pages)  # the threshold on paths is what finds it


def test_names_are_hints():
    text = "A long sentence, with words. Another one, with more words, and an end. And a third, to be sure."
    page = f"<body><div><div class='ad-slot'><b>Buy</b></div><div class='social-policy'><p>{text}</p><p>{text}</p></div></div></body>"
    assert main_text(page) == f"{text}\n{text}"
    assert main_text(f"<article><p>{text}</p><div class='x comments'><p>{text}</p></div><div class='ad-slot'>Buy</div></article>") == text


def test_extracted(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    rows = html_text.extracted(pages.withColumnsRenamed({"url": "text", "page_id": "n_chars"}).selectExpr("*", "text AS url", "1 AS page_id"), key="n_chars", url="text").collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in rows) == sorted((str(k), str(u), main_text(h)) for k, u, h in PAGES)
    assert html_text.extracted(pages.where("false")).collect() == []
    long = spark.createDataFrame([(1, "u", "<article>" + "<p>many words, here.</p>" * 100_000)], SCHEMA)
    assert html_text.extracted(long).first().text.count("\n") == 99_999


def test_deep_and_unclosed_pages_stay_linear():
    import time

    for page in ("<div>x" * 50_000, "<iframe>x" * 50_000, "<div>x" * 30_000 + "</p>" * 30_000, "<title>x " * 50_000, "<ul><li>a" * 20_000, "<p>x</section>" * 50_000):
        began = time.process_time()
        assert len(html_text.main_text(page)) > 10_000
        assert time.process_time() - began < 10  # under a second on a quick, idle machine


def test_links_beside_the_article_leave():
    text = "".join(f"<p>Sentence {i} of the text, which is long enough, says what there is to say.</p>" for i in range(9))
    more = "<div>" + "".join(f"<p><a href='/{i}'>Next story {i}</a></p>" for i in range(5)) + "</div>"
    found = html_text.main_text(f"<body><main><h1><a href='/'>Title</a></h1><div class='text'>{text}</div>{more}</main></body>")
    assert found.startswith("Title\nSentence 0") and found.count("\n") == 9 and "Next story" not in found


def test_revisits_refer_to_a_record_of_the_archive(spark, tmp_path):
    rows = [(3, "http://b/ x", "<p>same"), (1, "http://a/", "<p>same"), (2, None, "<p>same"), (4, "http://d/", "<p>other")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    found = [h for p in (tmp_path / "w").glob("part-*") for h, _ in warc.records_in(p.read_bytes())]
    responses = {h["x-page-id"]: h["warc-target-uri"] for h in found if h["warc-type"] == "response"}
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert set(responses) == {"1", "4"} and len(revisits) == 2
    assert all(responses[h["x-refers-to-page-id"]] == h["warc-refers-to-target-uri"] == "http://a/" and "warc-refers-to" not in h for h in revisits)
