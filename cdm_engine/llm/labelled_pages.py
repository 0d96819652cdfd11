"""Pages labelled by hand, in layouts of many kinds of sites (texts are invented): ``data-main="1"`` marks the elements of
the main text and ``data-main="0"`` what inside them is none, both inherited downwards. The labels are never features."""

PAGES = [
    # a regional newspaper
    """<body><div class="skip"><a href="#c">Skip to content</a></div><header class="site-top"><a class="logo" href="/">The Harbour Post</a><div class="date">Tuesday</div></header>
<nav class="mainnav"><ul><li><a href="/l">Local</a></li><li><a href="/s">Sport</a></li><li><a href="/o">Obituaries</a></li></ul></nav>
<div class="columns"><div class="story" data-main="1"><h1 class="headline">Ferry returns after two winters</h1><p class="lead">The small ferry between the islands sails again from Friday, its owners said.</p>
<p>It had lain in the yard since a storm bent the ramp. Parts came late, and then the yard had no welders.</p><aside class="pullquote">"We never gave her up."</aside>
<div class="inline-promo" data-main="0"><a href="/n">Sign up for our morning letter</a></div><p>Crossings are free on the first day. A timetable hangs at both piers.</p></div>
<div class="rail"><h3>Most read</h3><ol><li><a href="/1">Fire at the old mill</a></li><li><a href="/2">Council votes on parking</a></li></ol><div class="adbox">Windows and doors, call today</div></div></div>
<footer class="bottom"><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a><p>Printed and published in the harbour since 1911.</p></footer></body>""",
    # help pages of a program
    """<body><div class="topbar"><a href="/">Docs</a><div class="version-picker">Version 4</div></div><div class="docs-sidebar"><ul><li><a href="/a">Start</a></li><li><a href="/b">Queries</a></li><li><a href="/c">Limits</a></li></ul></div>
<main class="docs-content" data-main="1"><h1>Limits</h1><p>Requests are limited by account and by minute.</p><div class="admonition tip"><p>Spread large jobs over the night.</p></div>
<h2>What counts</h2><ul><li>Each call counts once.</li><li>Failed calls count as well, unless the server was at fault.</li></ul><pre><code>limit = 600</code></pre><p>A call beyond the limit gets status 429 and a header that tells when to try again.</p>
<div class="page-nav" data-main="0"><a href="/b">Previous: Queries</a> <a href="/d">Next: Errors</a></div></main><div class="feedback"><p>Was this page helpful?</p><button>Yes</button></div><div class="legal-bar">Terms of use</div></body>""",
    # a journal, names by a compiler
    """<body><div class="sc-a1"><div class="sc-b2"><a href="/">Longread</a><a href="/login">Sign in</a></div></div><div class="sc-c3"><div class="sc-d4" data-main="1"><h1 class="sc-e5">What the salt remembers</h1>
<h2 class="sc-f6">A walk through the last pans of the coast</h2><p class="sc-g7">The pans lie behind the dyke like windows that somebody left on the ground. In summer they are white, and in winter they are nothing.</p>
<p class="sc-g7">My grandfather raked here.</p><p class="sc-g7">He said that salt was the only crop that rain could steal in an hour, and that he had seen it stolen nine times.</p>
<div class="sc-h8" data-main="0"><p>You have two free stories left this month. Subscribe now.</p></div><p class="sc-g7">Today a trust keeps four pans alive for visitors, who carry the salt home in paper bags.</p></div>
<div class="sc-i9"><div><a href="/t1">Travel</a><a href="/t2">Essay</a></div><div>Written by M. Ferreira, who lives by the sea.</div></div></div><div class="sc-j0"><a href="/about">About</a><a href="/jobs">Jobs</a></div></body>""",
    # a blog with comments and a bar of widgets
    """<body class="single"><div id="wrapper"><div id="site-header"><h2><a href="/">Slow wheels</a></h2><p>Cycling without a clock</p></div><div id="nav"><a href="/">Home</a><a href="/routes">Routes</a><a href="/gear">Gear</a></div>
<div id="main-col"><div class="post-body" data-main="1"><h1>Three days along the canal</h1><p>We set out with one map and too much bread.</p><p>The towpath is gravel as far as the second lock, and grass after that. After rain you push.</p>
<figure><img src="x"><figcaption>The second lock, with geese</figcaption></figure><h3>Where to sleep</h3><p>There is a meadow behind the pumping house where nobody minds a tent, if it is gone by eight.</p><blockquote>Leave the gate as you find it.</blockquote></div>
<div class="sharedaddy"><span>Share this:</span><a href="#">Mail</a><a href="#">Print</a></div><div class="author-box"><p>Jo writes about slow travel and mends bicycles.</p></div>
<div id="comments"><h3>2 thoughts on this</h3><ol class="commentlist"><li><div class="comment-author">Pia</div><p>We slept there in 2014 and a cow ate our map.</p></li><li><div class="comment-author">Ned</div><p>Is the café still open?</p></li></ol></div></div>
<div id="sidebar"><div class="widget"><h4>Recent posts</h4><ul><li><a href="/1">A better saddle</a></li></ul></div><div class="widget"><h4>Blogroll</h4><a href="http://x">Old tracks</a></div></div><div id="footer">Theme by nobody in particular</div></div></body>""",
    # an office of a city
    """<body><div class="cookie-layer"><p>This site uses only necessary cookies.</p><a href="#">Understood</a></div><div id="kopf"><a href="/">City of Lindau</a></div><ul id="pfad"><li><a href="/">Home</a></li><li><a href="/amt">Offices</a></li></ul>
<div id="inhalt" data-main="1"><h1>Registering a change of address</h1><p>Whoever moves within the city must register the new address within two weeks.</p><h2>What you need</h2><ul><li>Identity card or passport</li><li>A letter from the landlord</li></ul>
<h2>Fees</h2><p>None.</p><dl><dt>Opening hours</dt><dd>Monday to Thursday, 8 to 12</dd><dt>Room</dt><dd>114</dd></dl></div><div id="rechts"><h3>Contact</h3><p>Call 115 from any phone.</p><form><label>Search</label><input name="s"></form></div><div id="fuss"><a href="/i">Imprint</a><a href="/b">Accessibility</a></div></body>""",
    # a shop's journal
    """<body><div class="announcement-bar">Free shipping above 60</div><header class="shop-header"><a href="/cart">Cart (0)</a><a href="/account">Account</a></header><div class="mega-menu"><a href="/tea">Tea</a><a href="/pots">Pots</a></div>
<article class="journal-entry" data-main="1"><h1>Brewing cold tea</h1><p>Cold water draws less bitterness from the leaf, so time takes the place of heat.</p><ol><li>Ten grams of leaf for a litre.</li><li>Eight hours in the cold.</li><li>Strain, and drink within two days.</li></ol>
<div class="product-card" data-main="0"><a href="/p">Sencha, 100 g</a><span>12.90</span><button>Add to cart</button></div><p>Green teas do best. Black ones taste flat, though some people like that.</p></article>
<section class="related-products"><h2>Goes well with</h2><div class="card"><a href="/p2">Glass jug</a></div></section><section class="newsletter-signup"><h2>Ten percent off</h2><p>Join our list and get ten percent off your first order.</p></section><footer class="shop-footer"><ul><li><a href="/r">Returns</a></li></ul></footer></body>""",
    # a club's old page made of tables
    """<html><body bgcolor="#ffffee"><center><table width="760"><tr><td colspan="2"><font size="5">Chess club of the upper valley</font></td></tr><tr><td width="140" valign="top"><a href="i.htm">Start</a><br><a href="t.htm">Teams</a><br><a href="g.htm">Guestbook</a></td>
<td data-main="1"><h2>Report of the winter tournament</h2><p>Eighteen players came in spite of the snow, more than in any year before.</p><p>In the last round the two leaders met, and after five hours they agreed on a draw. So the prize went to the third.</p>
<table border="1"><tr><th>Place</th><th>Name</th></tr><tr><td>1</td><td>Karl Hofer</td></tr><tr><td>2</td><td>Anna Reiter</td></tr></table><p>Thanks to all who brought cake!</p></td></tr><tr><td colspan="2"><small>You are visitor 20413. Webmaster: <a href="mailto:x">mail</a></small></td></tr></table></center></body></html>""",
    # a press release
    """<body><div class="global-nav"><a href="/products">Products</a><a href="/investors">Investors</a></div><div class="container"><div class="press-release" data-main="1"><h1>Norden Pumps opens works in the south</h1><p>Today Norden Pumps opened its fourth works, where 300 people will make pumps for wells.</p>
<p>"Water is the oldest need", said the head of the company.</p><p>The works takes its power from its own roof and needs none from the grid on sunny days.</p><h4>About Norden Pumps</h4><p>Norden Pumps was founded in 1954 and has works in three countries.</p></div>
<div class="media-contact"><h4>Media contact</h4><p>Press office, by telephone on weekdays.</p></div><div class="more-news"><a href="/1">Results of the third quarter</a><a href="/2">New pump for deep wells</a></div></div><div class="footer-links"><a href="/legal">Legal notice</a></div><div class="cookie-settings">Change cookie settings</div></body>""",
    # a magazine of science with boxes
    """<body><div role="banner"><a href="/">Field and Lens</a></div><div class="subscribe-strip"><p>Support our work: read everything for a coin a week.</p></div><div class="article-wrap"><div class="article__body" data-main="1"><h1>How bees keep warm</h1>
<p>A cluster of bees in January is a slow machine. The ones outside are cold and still; the ones inside shiver, and change places with them.</p><p>Measured with a fine wire, the core stays at 34 degrees, whatever the wind does.</p>
<div class="infobox"><h3>Numbers</h3><p>A colony eats some 15 kg of honey in a winter.</p></div><p>Keepers once wrapped hives in straw. It does little, it seems, but keeps woodpeckers away.</p><h2>A question of water</h2><p>Breath condenses under the lid and drips. More colonies die wet than cold.</p></div>
<div class="article__tags"><a href="/t">Insects</a><a href="/w">Winter</a></div><div class="recirc"><h3>Read this next</h3><a href="/r">The moth that hears bats</a></div></div><div role="contentinfo">All texts under licence.</div></body>""",
    # questions and answers of a company
    """<body><nav class="breadcrumbs"><a href="/">Help</a> / <a href="/pay">Payment</a></nav><section class="kb-article" data-main="1"><h1>Why was my card declined?</h1><p>There are three common reasons.</p><p><strong>The date.</strong> Check whether the card has run out.</p><p><strong>The limit.</strong> Many banks have a limit a day, which you can raise by telephone.</p><p><strong>The address.</strong> It has to be the one that your bank knows.</p></section>
<section class="kb-vote"><p>12 out of 15 found this helpful</p></section><section class="kb-related"><h2>Related articles</h2><ul><li><a href="/1">Paying by invoice</a></li><li><a href="/2">Refunds</a></li></ul></section><div class="chat-widget">Hello! How can we help?</div><div class="contact-us"><a href="/c">Submit a request</a></div></body>""",
    # a travel guide, paragraphs without classes and a notice in front
    """<body><div class="alert-banner">Some places may be closed on holidays.</div><div class="hd"><a href="/">Guide to the hills</a></div><div class="bd"><div class="tx" data-main="1"><h1>Monastery of Saint Orin</h1><p>Two hours on foot from the bus.</p><p>The church was built by masons from the plain, who signed each arch with a fish. There are thirty-one fish, and a child finds them faster than you do.</p><p>The well in the yard is older than the walls.</p><h2>Getting there</h2><p>Take the bus to Lower Orin and follow the red marks. The path is steep at the end but never narrow.</p></div>
<div class="bx"><h3>Nearby</h3><a href="/1">Mill of Orin</a><a href="/2">Salt cave</a></div><div class="bx"><h3>Rooms</h3><p>Book a bed in the village from 20 a night.</p></div></div><div class="ft"><a href="/k">Contact</a></div></body>""",
    # a law, article by article
    """<body><div id="tools"><a href="/print">Print</a><a href="/pdf">PDF</a></div><div id="toc"><ul><li><a href="#1">Purpose</a></li><li><a href="#2">Terms</a></li></ul></div><div id="text" data-main="1"><h1>Act on common wells</h1><h2>Purpose</h2><p>(1) This act orders the use of wells that more than one household shares.</p><p>(2) It does not apply to wells on public land.</p><h2>Terms</h2><p>A household is who lives under one roof.</p><ol><li>Children count.</li><li>Guests do not.</li></ol></div><div id="note"><p>This is not an official edition.</p></div><div id="bottom"><a href="/top">Top</a></div></body>""",
    # a magazine's page with everything that sells
    """<body><div class="modal subscribe-modal"><h2>Never miss a story</h2><p>Get our best stories by mail each Sunday.</p><button>No thanks</button></div><div class="leaderboard">Advertisement</div><div class="masthead"><a href="/">Hearth</a></div><div class="site-nav"><a href="/food">Food</a><a href="/home">Home</a></div>
<div class="content-main"><div class="entry-body" data-main="1"><h1>Five ways with old bread</h1><p>Bread that is too hard to cut is not too old to eat.</p><h2>1. Soup</h2><p>Soak it in broth with garlic and an egg.</p><h2>2. Dumplings</h2><p>Milk, parsley, patience.</p><div class="ad-unit" data-main="0">Advertisement</div><h2>3. Crumbs</h2><p>Dry it wholly, grate it, and keep it in a jar for as long as you like.</p></div>
<div class="social-bar"><a href="#">Pin</a><a href="#">Tweet</a></div><div class="reader-comments"><h3>Comments</h3><div class="c"><p>My aunt made the dumplings with nutmeg, never parsley.</p></div></div><div class="sponsored-links"><a href="/x">One trick that ovens hate</a><a href="/y">You will not believe this kitchen</a></div></div><div class="fine-print">A part of the Hearth group.</div></body>""",
]
