"""Pages of other templates than those trained on, and pages that are hostile to a parser."""

import time

import pytest

from pgq.llm import html_main as H

BLOG = """<html lang=en><head><meta charset=utf-8><title>x</title><style>.a{b:c}</style></head><body class="home single">
<div id="page"><div class="site-header"><a href="/">My site</a><ul id="primary-menu" class="menu"><li><a href="/a">About</a><li><a href="/c">Contact us</a></ul></div>
<div id="content" class="site-content"><div class="post hentry"><h1 class="entry-title">How rivers bend</h1>
<div class="entry-content"><p>Rivers bend because the water on the outside of a curve moves faster, and so it cuts into its bank.
<p>On the inside the water is slow &mdash; sand settles there, and a point bar grows year by year.</p><ul><li>The outer bank is steep.</li><li>The inner bank is flat.</li></ul></div></div>
<div id="comments" class="comments-area"><h2>2 replies</h2><ol class="comment-list"><li class="comment"><p>Thanks, I never knew that, it was a good read.</p></li></ol></div></div>
<div id="secondary" class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div>
<footer id="colophon"><p>Copyright 2021 My site. All rights reserved.</p></footer></div><script>if (a < b) { document.write("<p>no</p>"); }</script></body></html>"""
NEWS = """<body><header role=banner><nav><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></nav></header><div class=cookie-consent>We use cookies. <button>OK</button></div>
<main><article><header><h1>Bridge opens after ten years</h1></header><section><p>The bridge over the northern arm was opened on Monday, ten years after work began, and the first cars crossed it at noon.</p>
<aside class="ad advert"><p>Buy one lamp, get two, this week only!</p></aside><p>"It was a long time coming," said the mayor, who cut the ribbon with a pair of garden shears.</p></section></article></main>
<aside class="related"><h3>Read more</h3><ul><li><a href=/x>Tunnel closes</a></ul></aside><form action=/s><input name=q><button>Search</button></form><footer>&copy; The Paper</footer>"""


@pytest.mark.parametrize("page, has, lacks", [
    (BLOG, ["How rivers bend", "cuts into its bank.", "slow — sand settles there", "The outer bank is steep. The inner bank is flat."], ["About", "Thanks", "Recent", "Copyright", "no"]),
    (NEWS, ["Bridge opens after ten years", "first cars crossed it at noon.", "garden shears."], ["World", "cookies", "lamp", "Tunnel", "Search", "©"]),
])
def test_other_templates(page, has, lacks):
    got = H.extract(page, H.model())
    assert all(x in got for x in has), got
    assert not any(f" {x}" in f" {got}" for x in lacks), got


N = 1 << 20


@pytest.mark.parametrize("unit", ["<a ", "<b x=\"", "<b x='\"", "<div>", "<li><p>", "<table><tr><td>", "<b \"><b \"", "</p>", "&amp;", "<![CDATA[", "<p><table><td><div>", "<", "a<b>"])
@pytest.mark.parametrize("tail", ["", ">", "\">"])
def test_a_megabyte_of_anything_is_parsed_in_linear_time(unit, tail):
    began = time.process_time()
    t = H.parse(unit * (N // len(unit)) + tail)
    assert time.process_time() - began < 15 and len(t.tag) >= 1  # seconds: a quadratic parser takes an hour


def test_a_megabyte_of_nested_elements_is_extracted():
    began = time.process_time()
    assert H.extract("<div>" * (N // 5) + "deep", H.model()) in ("", "deep")
    assert time.process_time() - began < 60


@pytest.mark.parametrize("src, want", [
    ("a <b>c</b>", ["a ", "c"]), ("x < y", ["x < y"]), ("<p title='a > b'>q", ["q"]), ('<p title="a>q', ["q"]), ("<a <b", ["<a <b"]), ("t <i x", ["t ", "<i x"][:0] or ["t <i x"]),
    ("<!-- <p>no</p> -->yes", ["yes"]), ("<![CDATA[<q>]]>r", ["<q>", "r"]), ("<script>'<p>'</script>z", ["z"]), ("<!-- open", []), ("<p>a<p>b</p>c", ["a", "b", "c"]),
])
def test_text_of_odd_markup(src, want):
    assert [x for _, x in H.parse(src).content] == want


def test_tokens_are_learned():
    told = H.model().told
    assert told["content"] > 0.5 > -0.5 > told["sidebar"] and told["comments"] < -0.5
