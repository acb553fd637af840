"""Pages in the markup of various kinds of sites, each with its main text: what stands in [[ ]].

Their names and structures are written by hand and not those of the pages that the classifier is
fitted on. Each is filled with sentences of four languages: 16 markups, 64 pages.
"""

import re

TEXTS = [
    ["Storm over the bay", "The storm came in from the west shortly after noon and took the roofs of four barns with it.", "Nobody was hurt, the mayor said.", "Repairs will take until spring, since slate is scarce and masons are scarcer still.", "What comes next", "A fund has been opened; see the town's own page for how to give.", "Two roads remain closed"],
    ["Ein Sturm über der Bucht", "Kurz nach Mittag kam der Sturm von Westen und nahm die Dächer von vier Scheunen mit sich.", "Verletzt wurde niemand.", "Die Arbeiten dauern bis zum Frühjahr, denn Schiefer ist knapp und Maurer sind noch knapper.", "Wie es weitergeht", "Ein Fonds ist eröffnet; wie man spendet, steht auf der Seite der Stadt.", "Zwei Straßen bleiben gesperrt"],
    ["Une tempête sur la baie", "La tempête est venue de l'ouest peu après midi et a emporté les toits de quatre granges.", "Personne n'a été blessé.", "Les travaux dureront jusqu'au printemps, car l'ardoise est rare et les maçons le sont encore plus.", "La suite", "Un fonds est ouvert ; la page de la ville dit comment donner.", "Deux routes restent fermées"],
    ["Tormenta sobre la bahía", "La tormenta llegó del oeste poco después del mediodía y se llevó los tejados de cuatro graneros.", "Nadie resultó herido.", "Las obras durarán hasta la primavera, porque la pizarra escasea y los albañiles aún más.", "Lo que viene", "Se ha abierto un fondo; la página del pueblo dice cómo dar.", "Dos caminos siguen cerrados"],
]

PAGES = {
    "weblog": """<body class="post-template single has-sidebar"><div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a><header id="masthead" class="site-header"><p class="site-title"><a href="/">My weblog</a></p><nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main><article id="post-12" class="post-12 post type-post hentry category-news tag-social"><header class="entry-header"><h1 class="entry-title">[[{0}]]</h1></header><div class="entry-content"><p>[[{1}]]</p><p>[[{2}]]</p><div class="sharedaddy social-share"><h3>Share this:</h3><ul><li><a href="#">Mail</a></li></ul></div><h2>[[{4}]]</h2><p>[[{3}]]</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>I was there and it was far worse than they say here, believe me.</p></article></li></ol></div></main><aside id="secondary" class="widget-area"><section class="widget"><h2>Archives</h2><ul><li><a href="/5">May</a></li></ul></section></aside></div><footer class="site-footer">Proudly powered by something, as the theme will have it.</footer></div></body>""",
    "newspaper": """<body><div class="cookie-consent"><p>We and our partners store information on your device. You can change that at any time.</p><button>Accept</button></div><div class="topbar"><a href="/login">Sign in</a></div><nav role="navigation"><a href="/w">World</a> <a href="/s">Sport</a></nav>
<main class="story"><h1>[[{0}]]</h1><div class="story-body"><p>[[{1}]]</p><div class="ad-slot">Advertisement</div><p>[[{2}]]</p><figure><img src="x.jpg"></figure><p>[[{3}]]</p><aside class="related"><h4>More on this</h4><ul><li><a href="/2">Last year's storm and what it cost the county</a></li></ul></aside><h2>[[{4}]]</h2><p>[[{5}]]</p></div></main>
<section class="newsletter-signup"><p>Get our morning briefing in your inbox every weekday.</p><form><input><button>Subscribe</button></form></section><footer><p>All rights reserved. No part may be used without leave.</p></footer></body>""",
    "tables": """<body bgcolor="white"><table width="100%"><tr><td><a href="/">Home</a> | <a href="/map">Map</a> | <a href="/mail">Mail</a></td></tr></table><table><tr><td width="120"><a href="/a">News</a><br><a href="/b">Weather</a><br><a href="/c">Links</a></td><td><h1>[[{0}]]</h1><p>[[{1}]]<p>[[{2}]]<p>[[{3}]]<p>[[{5}]]</td></tr></table><p class="copyright">Copyright 1999 by us.</p></body>""",
    "forum": """<body class="no-sidebar"><div class="navbar"><a href="/">Board index</a></div><div id="main"><div class="post-content"><h1>[[{0}]]</h1><div>[[{1}]]</div><div>[[{3}]]</div></div><div class="replies"><div class="reply"><p>Thanks for telling us, I had wondered about the barns.</p></div><div class="reply"><p>Same here, and the road by the mill is under water as well.</p></div></div><form class="respond"><textarea>Your answer</textarea><button>Send</button></form></div><div class="footer"><a href="/rules">Rules</a></div></body>""",
    "manual": """<body><header><a href="/">Project</a><form role="search"><input></form></header><div class="layout"><div class="sidebar"><ul><li><a href="/1">Install</a></li><li><a href="/2">Use</a></li></ul></div><div class="documentation"><article><h1>[[{0}]]</h1><p>[[{1}]]</p><pre>[[{5}]]</pre><ul><li>[[{2}]]</li><li>[[{6}]]</li></ul><h2>[[{4}]]</h2><p>[[{3}]]</p></article><div class="pagination"><a href="/p">Previous</a> <a href="/n">Next</a></div></div></div><footer>Built with a tool for such pages.</footer></body>""",
    "bare": """<h1>[[{0}]]</h1><p>[[{1}]]</p><p>[[{2}]]</p><p>[[{3}]]</p><p>[[{5}]]</p>""",
    "wiki": """<body class="mediawiki ltr skin-old"><div id="content" class="mw-body" role="main"><h1 id="firstHeading">[[{0}]]</h1><div id="bodyContent"><div class="mw-parser-output"><p>[[<b>{1}</b>]]</p><h2><span id="comment-on-it">[[{4}]]</span></h2><p>[[{3}]]</p><p>[[{5}]]</p></div></div></div><div id="mw-navigation"><div class="menu"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li></ul></div></div><footer id="footer" role="contentinfo"><ul><li>This page was last changed a while ago.</li></ul></footer></body>""",
    "whole form": """<body><form id="aspnetForm" method="post"><div class="header"><a href="/">Town of B.</a></div><div class="menu"><ul><li><a href="/1">Services</a></li><li><a href="/2">Council</a></li></ul></div><div class="content"><h1>[[{0}]]</h1><p>[[{1}]]</p><p>[[{3}]]</p><p>[[{5}]]</p></div><div class="footer"><p>Town hall, Main Street 1.</p></div></form></body>""",
    "magazine": """<body><div class="wrapper"><div class="masthead"><a href="/">The Review</a></div><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/e">Essays</a></div><div class="article-wrap"><h1>[[{0}]]</h1><div class="article-text"><p>[[{1}]]</p><blockquote>[[{2}]]</blockquote><p>[[{3}]]</p><div class="promo-box"><p>Subscribe now and read four issues for the price of three.</p></div><p>[[{5}]]</p></div></div><div class="popular-posts"><h3>Most read</h3><ul><li><a href="/7">On fog</a></li></ul></div></div></body>""",
    "comments inside": """<article class="blog"><h1>[[{0}]]</h1><p>[[{1}]]</p><p>[[{3}]]</p><section id="disqus_thread" class="discussion"><h3>Join the discussion</h3><p>It was not the first storm of this kind, and will not be the last.</p><p>Ask the insurers, they know.</p></section></article><div class="copyright">(c) the authors</div>""",
    "odd names": """<body class="right-sidebar"><div class="social-science"><article class="related-rates comments-closed"><h1>[[{0}]]</h1><p id="hidden-costs">[[{1}]]</p><h2 id="share-of-it">[[{4}]]</h2><p>[[{3}]]</p></article></div><div class="sidebar-right"><p>Our institute has been studying such things since 1971, with success.</p></div></body>""",
    "popup first": """<body><div role="dialog" class="overlay"><h2>Wait!</h2><p>Before you go, take ten per cent off your first order with us.</p></div><div class="notice">This shop is closed on Monday.</div><section><h1>[[{0}]]</h1><p>[[{1}]]</p><p>[[{2}]]</p><p>[[{3}]]</p></section><ul class="tagcloud"><li><a href="/t">storm</a></li><li><a href="/u">roof</a></li></ul><div>Call us: <a href="tel:1">555</a></div></body>""".replace("<div>Call us: <a href=\"tel:1\">555</a></div>", '<footer>Call us: <a href="tel:1">555</a></footer>'),
    "unclosed": """<body><nav><ul><li><a href=/a>Alpha<li><a href=/b>Beta</ul></nav><article><h1>[[{0}]]</h1><p>[[{1}]]<p>[[{2}]]<ul><li>[[{3}]]<li>[[{6}]]</ul><p>[[{5}]]</article><footer>&copy; us &middot; since 1990""",
    "lists of cards": """<body><header class="top"><a href="/">Site</a></header><main><article><h1>[[{0}]]</h1><p>[[{1}]]</p><p>[[{3}]]</p></article><div class="recommended"><a href="/1"><div><h3>How to mend a roof in a week</h3><p>It takes a ladder and a friend.</p></div></a><a href="/2"><div><h3>Slate or tile?</h3></div></a></div></main></body>""",
    "plain divs": """<div><a href="/">Start</a> <a href="/x">Contact</a> <a href="/y">Map</a></div><div><h1>[[{0}]]</h1><div>[[{1}]]</div><div>[[{2}]]</div><div>[[{3}]]</div><div>[[{5}]]</div></div><div><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></div>""",
    "mathematics": """<body><nav><a href="/">Notes</a></nav><article><h1>[[{0}]]</h1><p>[[{1}]]</p><p>[[So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds, as {6} shows.]]</p><object data="x.pdf"><p>[[{5}]]</p></object><p>[[{3}]]</p><script src=/a/>var leak = "<p>Never seen, not in any way.</p>";</script></article></body>""",
}


def gold_pages():
    """(name, page, main text) of each page."""
    for name, page in PAGES.items():
        for n, texts in enumerate(TEXTS):
            filled = re.sub(r"\{(\d)\}", lambda m, texts=texts: texts[int(m[1])], page)
            blocks = [" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in re.findall(r"\[\[(.*?)\]\]", filled, re.S)]
            yield f"{name} {n}", filled.replace("[[", "").replace("]]", ""), "\n\n".join(blocks)
