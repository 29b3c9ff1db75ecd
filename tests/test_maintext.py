"""Main text of pages: made layouts with known articles, and pages that are broken, empty or long."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from tidewrack.functions.maintext import main_text, with_main_text

WORDS = "river stone field glass harbour winter letter engine garden market signal copper valley museum paper bridge candle orchard".split()


def said(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)) + "."


def article(rnd):
    """Paragraphs, a list, a table, a quotation and headings with their words; some paragraphs hold a link."""
    parts, words = [], []

    def add(text, markup):
        words.extend(text.split())
        parts.append(markup)

    for k in range(rnd.randint(4, 12)):
        text = said(rnd, rnd.randint(15, 70))
        head, _, rest = text.partition(" ")
        add(text, rnd.choice([f"<p>{text}</p>", f"<p><a href='/x'>{head}</a> {rest}</p>", f"<p>{text}", f"<div class='para'>{head} <em>{rest}</em></div>"]))
        if k % 4 == 1:
            text = said(rnd, 4)
            add(text, f"<h2>{text}</h2>")
        if k % 5 == 2:
            rows = [said(rnd, 5) for _ in range(3)]
            add(" ".join(rows), "<ul>" + "".join(f"<li>{r}" for r in rows) + "</ul>")
        if k % 5 == 3:
            text = said(rnd, 12)
            add(text, f"<blockquote>{text}</blockquote>")
    return "".join(parts), words


def layout(rnd, body, unnamed=False):
    """One of several kinds of pages around a body: menus, side columns, related links, comments, notices."""
    links = lambda n: "".join(f"<li><a href='/{k}'>{said(rnd, rnd.randint(1, 6))}</a></li>" for k in range(n))
    menu = rnd.choice([f"<nav><ul>{links(9)}</ul></nav>", f"<div class='top-menu'><ul>{links(12)}</ul></div>", f"<div><ul>{links(15)}</ul></div>", f"<header><p>{said(rnd, 5)}</p><ul>{links(6)}</ul></header>"])
    side = rnd.choice([f"<aside><p>{said(rnd, 30)}</p><ul>{links(5)}</ul></aside>", f"<div id='sidebar'><p>{said(rnd, 25)}</p></div>", f"<div class='relatedLinks'><ul>{links(8)}</ul></div>", ""])
    after = rnd.choice([f"<div class='comments'><p>{said(rnd, 20)}</p><p>{said(rnd, 15)}</p></div>", f"<section role='complementary'><p>{said(rnd, 12)}</p></section>", ""])
    if unnamed:  # furniture that neither its names nor its links tell
        card = f"<div class='c{rnd.randint(1, 9)}'><h3><a href='/t'>{said(rnd, 6)}</a></h3><p>{said(rnd, 14)}</p></div>"
        side += rnd.choice([f"<div class='x1'><p>{said(rnd, 22)}</p></div>", f"<div class='cards'>{card * 3}</div>", f"<div><span>{said(rnd, 3)}</span><div>{said(rnd, 2)}</div><div>{said(rnd, 3)}</div></div>"])
        menu += rnd.choice([f"<div class='x2'>{said(rnd, 9)}</div>", f"<p>{said(rnd, 7)}</p>", ""])
    foot = rnd.choice([f"<footer><p>{said(rnd, 25)}</p></footer>", f"<div class='footer'><p>{said(rnd, 18)}</p><ul>{links(4)}</ul></div>"])
    held = rnd.choice([f"<article>{body}</article>", f"<div class='content'><div>{body}</div></div>", f"<main><article>{body}</article></main>", f"<div><div><div>{body}</div></div></div>", f"<table><tr><td><ul>{links(7)}</ul></td><td>{body}</td></tr></table>", f"<form>{body}</form>"])
    if unnamed and rnd.random() < 0.7:  # and that shares a wrapper with the text
        held, side = f"<div>{held}{side}</div>", ""
    return f"<!DOCTYPE html><html lang=en><head><title>T</title><script>var a='<p>no</p>';</script></head><body class='has-sidebar'>{menu}{held}{side}{after}{foot}<script>x()</script></body></html>"


def f1_of(unnamed):
    rnd, scores = random.Random(7), []
    for _ in range(400):
        body, words = article(rnd)
        got, want = Counter(main_text(layout(rnd, body, unnamed)).text.replace("|", " ").split()), Counter(words)
        scores.append(2 * (got & want).total() / (got.total() + want.total()))
    return sorted(scores)


def test_word_f1_of_made_pages():
    """F1 of words, as multisets, over 400 pages: with furniture that its names or links tell, and with more that they do not."""
    plain, harder = f1_of(False), f1_of(True)
    print("mean F1", sum(plain) / 400, sum(harder) / 400, "worst", plain[:3], harder[:3])
    assert sum(plain) / 400 >= 0.99 and sum(harder) / 400 >= 0.93 and sum(harder[:20]) / 20 >= 0.6


def test_facts_of_a_page():
    page = main_text(
        "<html><head><meta property='og:title' content='Said'><link rel='shortlink canonical' href=' https://a.example/x '><meta name='author' content='A. B.'>"
        "<script type='application/ld+json'>{\"@graph\": [{\"datePublished\": \"2024-05-06T07:08:09Z\"}]}</script><meta http-equiv='content-language' content='de'></head><body><h1>Head</h1><p>Text of some length for a page.</p></body></html>"
    )
    assert (page.title, page.canonical, page.author, page.published, page.language) == ("Said", "https://a.example/x", "A. B.", "2024-05-06T07:08:09Z", "de")
    assert main_text("<h1>Only <i>a</i> heading</h1><p>and a text</p>").title == "Only a heading"
    assert main_text("<title>a</title><svg><title>b</title></svg><p>c</p>").title == "a"
    assert main_text("<meta name=date content='yesterday'><p>x</p>").published is None


def test_two_parts_tables_and_furniture_in_articles():
    two = "<div><p>" + "one " * 30 + "</p></div><div class=ad>buy</div><div><p>" + "two " * 30 + "</p></div>"
    assert Counter(main_text(f"<body><nav><a href=/>home</a></nav>{two}</body>").text.split()) == Counter(one=30, two=30)
    assert main_text("<article><table><tr><th>Name<th>Age<tr><td>Ann<td>5</table></article>").text == "Name | Age\nAnn | 5"
    assert main_text("<article><header><h1>Head</h1></header><p>Some text here.</p><div class='share-links'>Send it</div></article>").text == "Head\nSome text here."
    assert main_text("<p>a<br>b<img>c &amp; d</p>").text == "a b c & d"


def test_broken_empty_and_long_pages():
    for html in (None, "", "   ", "</p></div>", "<html><body></body></html>", "<script>a", "<!-- x -->", "\0"):
        assert main_text(html).text == ""
    assert main_text("plain text only").text == "plain text only"
    assert main_text("<a href=/>" + "x " * 20 + "<div>" + "long " * 50 + "</div>").text == ""  # nothing but a link
    began = time.time()
    assert len(main_text("<div>" * 20_000 + "deep text " * 20 + "</div>" * 20_000).text.split()) == 40
    assert len(main_text("<article>" + "<p>word <b>and" * 100_000).text.split()) == 200_000
    assert len(main_text("</b></div>" * 50_000 + "<p>" + "word " * 1_000_000).text.split()) == 1_000_000
    assert time.time() - began < 60


def test_with_main_text_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "<p>a b c</p>", "x"), (2, None, "y"), (1, "<p>a b c</p>", "x")], "id int, `page.html` string, text string")
    got = with_main_text(df, "page.html").select("id", "text", F.col("page.text").alias("said")).collect()
    assert sorted(map(tuple, got)) == [(1, "x", "a b c"), (1, "x", "a b c"), (2, "y", "")]
    assert with_main_text(df.limit(0), "page.html").count() == 0


def test_main_text_of_response_records(spark):
    from tidewrack.sources.web import main_response_text, response_captures

    html = "<body><div class=menu>" + "menu " * 60 + "</div><article><p>" + "word " * 50 + "</p></article></body>"
    rows = [("p", n, "r", "u", "response", bytearray(b"HTTP/1.1 200 OK\r\n\r\n" + h.encode())) for n, h in enumerate((html, "<p>short</p>"))]
    records = spark.createDataFrame(rows, "path string, ordinal int, record_id string, url string, record_type string, payload binary")
    assert [r.text for r in response_captures(records, reader=main_response_text).collect()] == [" ".join(["word"] * 50)]
