"""Pages written by hand in layouts of their own: (html, the blocks of the main text)."""

PAGES = [
    # a weblog
    ("""<html><body class="home blog"><div id="page"><div id="masthead"><a href="/">Garden notes</a><span class="tagline">Twenty years of soil</span></div>
<div class="primary-menu"><a href="/about">About</a> <a href="/tools">Tools</a> <a href="/seeds">Seeds</a></div>
<div id="primary"><div class="hentry"><h1 class="entry-title">Why my beans failed</h1><div class="entry-meta">Posted by <a href="/u">Ruth</a></div>
<div class="entry-content"><p>Last spring I planted beans along the north wall, where they had a little light in the morning.</p>
<p>By June it was clear that they would not make it. The leaves were pale, and the stems were <a href="/thin">thin as thread</a>.</p>
<ul><li>Not enough light.</li><li>Too much water in May.</li></ul><p>Next year they go to the south side.</p></div></div>
<div id="respond"><h3>Leave a reply</h3><p>Your address will not be published.</p></div></div>
<div id="secondary" class="widget-area"><h2>Archives</h2><ul><li><a href="/3">March</a></li><li><a href="/4">April</a></li></ul></div>
<div id="colophon">Proudly powered by a press</div></div></body></html>""",
     ["Why my beans failed", "Last spring I planted beans along the north wall, where they had a little light in the morning.", "By June it was clear that they would not make it. The leaves were pale, and the stems were thin as thread.", "Not enough light.", "Too much water in May.", "Next year they go to the south side."]),
    # a news site with names made by a compiler
    ("""<body><div class="css-1f7ibof"><nav class="css-0"><ul><li><a href="/w">World</a></li><li><a href="/b">Business</a></li><li><a href="/s">Sport</a></li></ul></nav></div>
<div id="app"><main class="css-9qx"><article class="css-vp77d3"><h1 class="css-1l8">Bridge to open in autumn</h1>
<section class="css-xk"><p class="css-at9">The new bridge over the estuary will be open to traffic in October, the ministry said on Monday.</p>
<p class="css-at9">Work had been delayed twice by storms. The cost rose to 410 million, a third more than planned.</p>
<div class="dfp-slot" data-size="300x250">Advertisement: fly south for less.</div>
<p class="css-at9">Local traders welcomed the news. "We have waited ten years", said the owner of a garage on the east bank.</p></section></article>
<div class="more-stories"><h2>More stories</h2><a href="/1">Rain stops the fair</a><a href="/2">A mayor resigns</a></div></main></div>
<footer><p>All rights reserved.</p></footer></body>""",
     ["Bridge to open in autumn", "The new bridge over the estuary will be open to traffic in October, the ministry said on Monday.", "Work had been delayed twice by storms. The cost rose to 410 million, a third more than planned.", "Local traders welcomed the news. \"We have waited ten years\", said the owner of a garage on the east bank."]),
    # tables for layout
    ("""<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><A HREF=/>Home</A> | <A HREF=/links>Links</A> | <A HREF=/mail>Mail me</A></TD></TR>
<TR><TD WIDTH=120><A HREF=a>Engines</A><BR><A HREF=b>Brakes</A><BR><A HREF=c>Paint</A></TD>
<TD><H1>Restoring a carburettor</H1><P>Take it off the manifold first and drain what is left in the bowl into a glass jar.
<P>Clean the jets with a soft wire. Do not use a drill, however tempting that seems after an hour.
<P>Put it together with new gaskets &amp; set the idle screw one and a half turns out.</TD></TR></TABLE>
<CENTER>Last updated 1999</CENTER></BODY></HTML>""",
     ["Restoring a carburettor", "Take it off the manifold first and drain what is left in the bowl into a glass jar.", "Clean the jets with a soft wire. Do not use a drill, however tempting that seems after an hour.", "Put it together with new gaskets & set the idle screw one and a half turns out."]),
    # documentation with a table of contents
    ("""<body><header class="navbar"><a class="brand" href="/">Tool</a><form role="search"><input name="q"></form></header><div class="container">
<aside class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li></ul></aside><main role="main"><h1>Install</h1>
<p>The tool needs nothing but a compiler.</p><pre>make &amp;&amp; make install</pre><h2>Use</h2><p>Run it in any folder that has a file of tasks:</p><pre>tool run all</pre>
<table><tr><th>Flag</th><th>Meaning</th></tr><tr><td>quiet</td><td>say nothing</td></tr></table></main></div><div class="footer"><p>Licensed freely.</p></div></body>""",
     ["Install", "The tool needs nothing but a compiler.", "make && make install", "Use", "Run it in any folder that has a file of tasks:", "tool run all", "Flag", "Meaning", "quiet", "say nothing"]),
    # consent in front, comments of a service, hidden parts
    ("""<body><div id="gdpr"><p>We and our 812 partners store cookies on your device.</p><button>Accept all</button></div>
<article><h1>The quiet valley</h1><p>There is a valley two hours from the city where no road leads, and where the trains stop on demand.</p>
<p hidden>Subscribe to read on.</p><div style="display: none">tracking text</div><p>We walked in from the halt at seven, in fog, with the river on our left and cows somewhere above us.</p>
<svg><title>icon</title><svg><text>inner</text></svg><text>outer</text></svg><p>At noon the sun came out.</p></article>
<div id="disqus_thread"><p>Great read, thank you so much for this one!</p><p>I was there in 2011 and it has not changed a bit.</p></div></body>""",
     ["The quiet valley", "There is a valley two hours from the city where no road leads, and where the trains stop on demand.", "We walked in from the halt at seven, in fog, with the river on our left and cows somewhere above us.", "At noon the sun came out."]),
    # a recipe
    ("""<body><div class="top"><a href="/">Kitchen</a> <a href="/login">Log in</a></div><div class="recipe"><h1>Lentil soup</h1><p>Serves four, and better on the second day.</p>
<h2>Ingredients</h2><ul class="ingredients"><li>300 g brown lentils</li><li>two onions</li><li>a bay leaf</li></ul><h2>Method</h2><ol><li>Fry the onions slowly until they are golden.</li><li>Add lentils, leaf and water, and cook for forty minutes.</li></ol>
<div class="share"><a href="#">Share</a> <a href="#">Pin</a> <a href="#">Print</a></div></div><div class="newsletter"><p>Get a recipe a week by mail.</p></div><footer>Kitchen 2021</footer></body>""",
     ["Lentil soup", "Serves four, and better on the second day.", "Ingredients", "300 g brown lentils", "two onions", "a bay leaf", "Method", "Fry the onions slowly until they are golden.", "Add lentils, leaf and water, and cook for forty minutes."]),
    # an encyclopedia
    ("""<body><div id="mw-head"><ul><li><a href="/r">Read</a></li><li><a href="/e">Edit</a></li><li><a href="/h">View history</a></li></ul></div><div id="content"><h1 id="firstHeading">Heron</h1>
<div id="bodyContent"><p>Herons are long-legged birds of <a href="/w">wetlands</a>, with some sixty <a href="/s">species</a>.</p><div class="thumb"><div class="thumbcaption">A heron at dusk</div></div>
<h2>Habits</h2><p>They hunt standing still, mostly at dawn, and strike with the bill. Young birds learn this within weeks.</p></div></div>
<div id="mw-panel"><h3>Navigation</h3><ul><li><a href="/m">Main page</a></li><li><a href="/c">Contents</a></li></ul></div><div id="footer"><ul><li>This page was last edited in May.</li></ul></div></body>""",
     ["Heron", "Herons are long-legged birds of wetlands, with some sixty species.", "A heron at dusk", "Habits", "They hunt standing still, mostly at dawn, and strike with the bill. Young birds learn this within weeks."]),
    # a paper's abstract page, nothing named
    ("""<body><p><a href="/">Archive</a> <a href="/new">New</a> <a href="/help">Help</a></p><h1>On the spread of small waves</h1><p>A. Writer and B. Reader</p>
<p>We study how waves of small height spread over shallow water when the ground is rough. Two regimes are found, and a simple law joins them.</p>
<p>The law is tested with a tank of twelve metres and holds within four percent.</p><hr><p><a href="/1">Previous</a> <a href="/2">Next</a></p></body>""",
     ["On the spread of small waves", "A. Writer and B. Reader", "We study how waves of small height spread over shallow water when the ground is rough. Two regimes are found, and a simple law joins them.", "The law is tested with a tank of twelve metres and holds within four percent."]),
    # a shop's guide with promotions in between
    ("""<body><header><div class="logo"><a href="/">Shoes</a></div><nav><a href="/m">Men</a><a href="/w">Women</a></nav></header><div class="guide"><h1>How to choose boots</h1>
<p>Boots last long if they fit. Measure both feet in the evening, when they are largest.</p><div class="promo"><p>Now 20 percent off all boots!</p></div>
<p>Leather is warm and can be mended. Rubber is light, but once torn it is gone.</p><h3>Care</h3><p>Dry them slowly, never on a stove.</p></div>
<section class="recommended"><h2>You may also like</h2><ul><li><a href="/1">Laces</a></li><li><a href="/2">Wax</a></li></ul></section><div class="site-footer">Terms | Privacy</div></body>""",
     ["How to choose boots", "Boots last long if they fit. Measure both feet in the evening, when they are largest.", "Leather is warm and can be mended. Rubber is light, but once torn it is gone.", "Care", "Dry them slowly, never on a stove."]),
    # a letter to the editor, then readers' replies
    ("""<body><div class="wrap"><div class="crumbs"><a href="/">Home</a> &gt; <a href="/letters">Letters</a></div><div class="letter"><h1>Save the library</h1><p>Sir, the plan to close our library on two days a week will save little and cost much.</p><p>Pupils go there in the afternoon because there is nowhere else.</p></div>
<div class="comments-area"><h2>3 comments</h2><div class="comment-body"><p>Hear, hear. My children are there every day.</p></div><div class="comment-body"><p>And who is going to pay for it?</p></div></div></div></body>""",
     ["Save the library", "Sir, the plan to close our library on two days a week will save little and cost much.", "Pupils go there in the afternoon because there is nowhere else."]),
]
