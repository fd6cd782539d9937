"""Labelled pages that the extraction model is trained on.

data-main="1" marks content; it holds for what is inside, until data-main="0".
%S, %M and %L stand for texts of a few words, a sentence or two, and a paragraph;
%B, %N, %C, %D and %X for a body, a menu, comments, a side part, and a part amid the body.
"""

from __future__ import annotations

import itertools
import re

SHORT = ("Latest news", "Home", "About us", "Contact", "Read more", "Sign in", "Terms of use", "A day at the harbour", "Open", "Seven notes on rain")
MIDDLE = ("The ferry leaves at nine. It is seldom late.", "Nobody had asked for it, and yet it came.", "We tested four of them over a week.", "In the end the bridge was closed; traffic went round by the mill.")
LONG = (
    "The valley had been dry for three years when the first storm arrived. People stood in their doors and watched the road turn to mud. By the evening the river was back in its bed, and nobody went to sleep before midnight.",
    "Measuring such a thing is harder than it sounds. A scale drifts, a clock runs slow, and the hand that writes the figures down gets tired. So we measured everything twice, and threw away what did not agree.",
    "She wrote to the council in spring, again in summer, and once more when the leaves had gone. The answer, when it came, had two lines. It thanked her for her interest, and it said that the matter was closed.",
    "Bread is flour, water, salt and time. Most of the recipes in the book change only the last of these, which is why they all taste different. Start with a small loaf, and write down what you did.",
)

LINKS = '<ul><li><a href="/1">%S</a></li><li><a href="/2">%S</a></li><li><a href="/3">%S</a></li></ul>'

PAGES = (
    # an article with semantic elements
    f"""<html><head><title>%S</title></head><body><header class="site-header"><a href="/">%S</a><p>%S</p></header><nav>{LINKS}</nav>
    <article data-main="1"><h1>%S</h1><p>%L</p><p>%L</p><div class="ad" data-main="0">%M</div><p>%M</p><h2>%S</h2><p>%L</p><blockquote><p>%M</p></blockquote><ul><li>%M</li><li>%M</li></ul></article>
    <aside class="sidebar"><h3>%S</h3>{LINKS}</aside><footer><p>%S</p>{LINKS}</footer></body></html>""",
    f"""<html><body><nav class="menu">{LINKS}</nav><div class="ad">%M</div><article data-main="1"><h1>%S</h1><p>%L</p><p>%M</p></article><footer>&copy; %S %M</footer></body></html>""",
    """<html><body><div class="advert">%M</div><div class="banner">%M</div><article data-main="1"><h1>%M</h1><p>%M</p></article><footer>%M</footer></body></html>""",
    """<html><body><article data-main="1"><h1>%S</h1><p>%L</p><p>%S</p><p>%S</p><p>%L</p></article></body></html>""",
    f"""<html><body><nav>{LINKS}</nav><article data-main="1"><p>%S</p></article><footer>%S</footer></body></html>""",
    # a layout of divs with names
    f"""<html><body><div id="header"><div class="logo">%S</div><div class="nav">{LINKS}</div></div><div id="content" data-main="1"><div class="post"><h2>%S</h2><div class="meta" data-main="0">%S</div><div class="entry"><p>%L</p><p>%L</p><p>%M</p></div><div class="share social" data-main="0"><a href="/s">%S</a> <a href="/t">%S</a></div></div></div>
    <div id="comments" class="comments"><h3>%S</h3><div class="comment"><p>%M</p></div><div class="comment"><p>%L</p></div><form><input name="a"><p>%S</p></form></div><div id="sidebar"><div class="widget">{LINKS}</div><div class="widget promo"><p>%M</p></div></div><div id="footer">%S %S</div></body></html>""",
    f"""<html><body><div class="cookie notice"><p>%M</p></div><div class="top menu">{LINKS}</div><div class="main"><div class="article body" data-main="1"><h1>%S</h1><p>%L</p><div class="ads sponsored" data-main="0"><p>%M</p></div><p>%L</p><p>%L</p></div><div class="related recommended"><h4>%S</h4>{LINKS}</div></div><div class="footer copyright legal"><p>%M</p></div></body></html>""",
    # a page with main, comments and a form
    f"""<html><body><header><nav>{LINKS}</nav></header><div class="alert notice banner" role="alert">%M</div><main data-main="1"><h1>%S</h1><section><h2>%S</h2><p>%L</p><p>%M</p></section><section><h2>%S</h2><p>%L</p><table><tr><td>%S</td><td>%S</td></tr></table></section>
    <section class="comments" data-main="0"><h2>%S</h2><div class="comment"><p>%M</p></div><div class="comment reply"><p>%L</p></div></section></main><form class="newsletter subscribe"><p>%M</p><label>%S</label></form><footer>{LINKS}<p>%S</p></footer></body></html>""",
    f"""<html><body><header class="page"><h1>%S</h1>{LINKS}</header><main><article data-main="1"><h2>%S</h2><p>%L</p><ol><li>%M</li><li>%L</li></ol><p>%L</p><figure><figcaption>%S</figcaption></figure></article><aside class="promo"><p>%L</p></aside></main><div class="popup modal consent"><p>%L</p></div><footer><div>%S</div><div>{LINKS}</div></footer></body></html>""",
    # a page of links
    f"""<html><body><nav>{LINKS}{LINKS}</nav><div class="breadcrumbs"><a href="/">%S</a></div><div class="list">{LINKS}{LINKS}</div><div class="pagination"><a href="/2">%S</a></div><footer>%M</footer></body></html>""",
    # plain paragraphs in the body
    f"""<html><body><div data-main="1"><h1>%S</h1><p>%L</p><p>%L</p><p>%M</p><p>%L</p></div><div class="menu">{LINKS}</div></body></html>""",
)

# parts that a page's frame is filled with, each of its own count, so that they meet in many ways
NAVS = (
    f'<div class="navbar">{LINKS}</div>',
    '<div><a href="/1">%S</a> | <a href="/2">%S</a> | <a href="/3">%S</a></div>',
    '<table><tr><td><a href="/1">%S</a></td><td><a href="/2">%S</a></td><td><a href="/3">%S</a></td></tr></table>',
    f'<header><h1><a href="/">%S</a></h1><nav>{LINKS}</nav></header>',
    '<ul class="topnav"><li><a href="/1">%S</a></li><li><a href="/2">%S</a></li></ul>',
)
COMMENTS = (
    '<ol class="commentlist"><li class="comment"><div class="vcard">%S</div><p>%M</p></li><li class="comment"><p>%L</p><ul class="children"><li><p>%M</p></li></ul></li></ol>',
    '<div id="disqus_thread"><div class="post-message"><p>%M</p></div><div class="post-message"><p>%L</p></div></div>',
    '<section class="responses"><h2>%S</h2><ul class="replies"><li><p>%L</p></li><li><p>%M</p></li></ul></section>',
    '<table class="comments"><tr><td>%S</td><td>%M</td></tr><tr><td>%S</td><td>%L</td></tr></table>',
    '<div id="respond"><h3>%S</h3><form><p>%M</p></form></div>',
    '<ul class="discussion"><li class="message"><b>%S</b><div>%M</div></li><li class="message"><b>%S</b><div>%L</div></li></ul>',
    "",
)
SIDES = (
    f'<aside><h3>%S</h3>{LINKS}<p>%M</p></aside>',
    '<div class="sidebar"><div class="widget"><h3>%S</h3><p>%M</p></div></div>',
    f'<div id="rail">{LINKS}{LINKS}</div>',
    '<div class="cookiebar"><p>%M</p></div><div class="adslot">%M</div>',
)
EXTRAS = (
    '<aside data-main="0"><p>%M</p></aside>',
    '<aside class="pullquote" data-main="0">%M</aside>',
    '<div class="advertisement" data-main="0"><p>%M</p></div>',
    f'<div class="related" data-main="0"><h4>%S</h4>{LINKS}</div>',
    '<form data-main="0"><p>%M</p></form>',
    "",
)
BODIES = (
    "<h1>%S</h1><p>%L</p>%X<p>%L</p><p>%M</p>",
    "<h2>%S</h2><p>%L</p><ul><li>%M</li><li>%S</li></ul>%X<p>%L</p>",
    "<h1>%S</h1><p>%L</p><table><tr><th>%S</th><th>%S</th></tr><tr><td>%S</td><td>%M</td></tr></table>%X<p>%L</p>",
    "<h1>%S</h1><div>%L</div><div>%L</div>%X<pre>%M</pre><dl><dt>%S</dt><dd>%M</dd></dl>",
    "<h1>%S</h1>%L<br><br>%L%X<blockquote>%M</blockquote>",
)
FRAMES = (
    '<html><body>%N<article data-main="1">%B</article>%C%D<footer>%S</footer></body></html>',
    '<html><body>%N<div><div data-main="1">%B</div>%D</div>%C<div>%S</div></body></html>',
    '<html><body>%N<table><tr><td>%D</td><td><div data-main="1">%B</div>%C</td></tr></table><p>%S</p></body></html>',
    '<html><body>%N<table><tr><td><a href="/4">%S</a><br><a href="/5">%S</a></td><td data-main="1">%B</td></tr></table>%C%D</body></html>',
    '<html><body>%D%N<main><section data-main="1">%B</section>%C</main><footer><div>%M</div></footer></body></html>',
    '<html><body>%N<div class="page"><div class="story" data-main="1">%B</div>%C</div>%D<div class="colophon">%M</div></body></html>',
)
#: Pages made of the parts.
MADE = 120


def made(i: int) -> str:
    """The ith page made of the parts."""
    page = FRAMES[i % len(FRAMES)]
    for mark, parts in (("%B", BODIES), ("%N", NAVS), ("%C", COMMENTS), ("%D", SIDES), ("%X", EXTRAS)):
        page = page.replace(mark, parts[(i + i // len(parts)) % len(parts)])
    return page


def labelled_pages() -> list[str]:
    """The pages with their texts filled in, the plain ones in three ways each, then those made of parts."""
    texts = {"S": itertools.cycle(SHORT), "M": itertools.cycle(MIDDLE), "L": itertools.cycle(LONG)}
    layouts = [page for page in PAGES for _ in range(3)] + [made(i) for i in range(MADE)]
    return [re.sub("%([SML])", lambda m: next(texts[m[1]]), page) for page in layouts]
