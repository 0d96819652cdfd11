"""Pages labelled by hand (``data-main``) that nothing is trained or chosen on, in other layouts than those of ``labelled_pages``."""

PAGES = [
    # a broadcaster
    """<body><div class="gel-wrapper"><a href="/">Channel Nine</a><a href="/news">News</a><a href="/weather">Weather</a></div><main id="main-content"><article><header><h1 data-main="1">Night trains come back to the coast</h1></header><div data-component="text-block" data-main="1"><p><b>From December there will be a sleeper between the capital and the coast, for the first time in sixteen years.</b></p></div><div data-component="text-block" data-main="1"><p>Tickets go on sale in October. A bed will cost no more than a cheap hotel.</p></div><div data-component="links-block"><h2>More on this story</h2><ul><li><a href="/a">Why the sleepers went</a></li><li><a href="/b">A night in car 14</a></li></ul></div><div data-component="text-block" data-main="1"><p>The line had lost money for years. What has changed is the price of a flight.</p></div></article></main><footer><ul><li><a href="/t">Terms</a></li><li><a href="/c">Cookies</a></li></ul><p>The channel is not responsible for other sites.</p></footer></body>""",
    # a museum
    """<body><div id="menu-toggle">Menu</div><div class="menu-overlay"><a href="/visit">Visit</a><a href="/shop">Shop</a></div><div class="page-content"><div class="object-text" data-main="1"><h1>Clock of a lighthouse</h1><p>The keeper wound it each evening at the lighting of the lamp.</p><p>It turned the lens once in forty seconds, for seventy-one years, and stopped for nine nights only.</p><table><tr><td>Made</td><td>1868</td></tr><tr><td>Material</td><td>Brass, iron</td></tr></table></div><div class="on-view"><a href="/plan">On view in room 6</a></div><div class="visit-teaser"><h3>Plan your visit</h3><p>Open daily but Tuesdays.</p></div></div><div class="partners"><a href="/s">With the help of our friends</a></div></body>""",
    # a diary of a programmer
    """<body><p><a href="/">home</a> &middot; <a href="/posts">posts</a> &middot; <a href="/feed">feed</a></p><article data-main="1"><h1>A bug that only came on Mondays</h1><p>For a month the import failed each Monday at four, and on no other day.</p><p>The log said nothing, of course.</p><pre>worker exited with status 137</pre><p>In the end it was the backup: it ran on Sundays, filled the cache with old pages and left the import nothing to breathe. We moved the backup. I should like to say that we understood the cache as well, but we did not.</p></article><p><a href="/prev">older</a> <a href="/next">newer</a></p><p><small>Written in a text editor. No trackers.</small></p></body>""",
    # a health portal
    """<body><div class="hc-header"><a href="/">Well and good</a><form><input name="q"></form></div><div class="hc-breadcrumb"><a href="/">Home</a><a href="/sleep">Sleep</a></div><div class="hc-layout"><div class="hc-article" data-main="1"><h1>Sleeping in the heat</h1><div class="hc-summary"><p>Cool the room early, drink enough, and eat late only if you must.</p></div><h2>Before bed</h2><p>Open all windows at dawn and shut them by nine. A wet sheet at the window helps for an hour or two.</p><h2>At night</h2><p>Feet out.</p><p>If you wake, do not fight it: get up, drink some water and read a dull book.</p><div class="hc-ad" data-main="0"><span>Advertisement</span></div><p>See a doctor if you are dizzy in the morning.</p></div><div class="hc-side"><div class="hc-promo"><h4>Free sleep diary</h4><p>Download it now.</p></div></div></div><div class="hc-disclaimer"><p>This page does not replace a doctor.</p></div><div class="hc-footer"><a href="/ed">Editors</a></div></body>""",
    # an encyclopedia of plants with a box
    """<body><div class="banner-donate"><p>If everyone who reads this gave a coin, we should be done today.</p></div><div class="tabs"><a href="/d">Discussion</a><a href="/e">Edit</a></div><div class="mw-body" data-main="1"><h1>Sea holly</h1><p>Sea holly is a plant of <a href="/dune">dunes</a>, blue and grey, up to half a metre high.</p><h2>Use</h2><p>Its roots were candied and sold as sweets in the seventeenth century.</p><h2>Threats</h2><p>Trampling, and the collecting of its <a href="/f">flowers</a>.</p><ul><li>Protected since 1941</li></ul></div><div class="catlinks"><a href="/c1">Plants of the coast</a><a href="/c2">Blue flowers</a></div><div class="sitenav"><a href="/m">Main page</a><a href="/r">Random page</a></div><div class="license">Text is free to use under the same terms.</div></body>""",
    # a parish letter without any names
    """<body><div><a href="/">Parish</a> <a href="/dates">Dates</a> <a href="/people">People</a></div><div data-main="1"><h1>Letter for September</h1><p>Dear all, the roof is done. It took eleven weeks, and no one fell.</p><p>We owe thanks to the carpenters, to the bakers who fed them, and to the wind, which stayed away.</p><p>On the third Sunday we eat together.</p></div><div><a href="/aug">August</a> <a href="/jul">July</a></div></body>""",
    # local sports with a table and polls
    """<body><div class="top-ad">Your advert here</div><ul class="nav-list"><li><a href="/f">Football</a></li><li><a href="/h">Handball</a></li></ul><div class="match-report" data-main="1"><h1>Late goal saves the point</h1><p>It looked lost after an hour, when the guests were two up and the rain had begun.</p><p>Then came the change.</p><p>Baro scored with his first touch, and in the last minute a corner fell to the keeper, of all people, who put it in with his knee.</p><table><tr><th>Goals</th><td>0:1 Lenz</td><td>0:2 Lenz</td><td>1:2 Baro</td><td>2:2 Kuhn</td></tr></table></div><div class="poll"><h3>Poll</h3><p>Who was your player of the match?</p></div><div class="latest"><h3>Latest</h3><ul><li><a href="/1">Handball: cup drawn</a></li><li><a href="/2">A new coach for the juniors</a></li></ul></div><div class="footer-bottom">Sport in the valley</div></body>""",
    # a transcript
    """<body><div class="player-bar"><a href="/play">Play episode</a></div><div class="site-menu"><a href="/all">All episodes</a></div><div class="transcript" data-main="1"><h1>Episode 31: The last typesetter</h1><p>HOST: You set your first line in 1961. What was it?</p><p>GUEST: An advert for hats.</p><p>HOST: And the last?</p><p>GUEST: My own name, in a drawer that nobody will open. One should leave something behind in a trade, and lead lasts.</p></div><div class="subscribe-box"><p>Hear us wherever you get your podcasts.</p></div><div class="episode-list"><a href="/30">Episode 30: Ink</a><a href="/29">Episode 29: Paper</a></div><div class="site-info">Made in a kitchen.</div></body>""",
    # a job
    """<body><header class="header"><a href="/">Jobs on the water</a></header><div class="posting" data-main="1"><h1>Lock keeper wanted</h1><p>We look for someone who can get up early and likes boats, or at least does not mind them.</p><h3>Tasks</h3><ul><li>Opening and closing two locks</li><li>Keeping the book</li><li>Mowing</li></ul><h3>We offer</h3><ul><li>A house with a stove</li><li>Quiet winters</li></ul><p>Write to us by the end of May.</p></div><div class="similar-jobs"><h3>Similar jobs</h3><a href="/1">Ferryman</a><a href="/2">Harbour clerk</a></div><div class="job-alert"><p>Get new jobs by mail.</p><input name="m"></div><footer class="footer"><p>No fees for seekers.</p></footer></body>""",
    # a review with stars and readers' opinions
    """<body><div class="ticker"><a href="/x">Live: the awards</a></div><div class="brand-bar"><a href="/">Screen weekly</a></div><div class="review-content" data-main="1"><h1>The long field</h1><p class="verdict">Four stars</p><p>Nothing happens in this film for forty minutes, and then a gate opens. You will not forget the sound of it.</p><p>The two leads hardly speak. They do not have to: one has the face of a man who counts fence posts, the other of one who has stopped counting.</p><p>See it in a large hall.</p></div><div class="user-reviews"><h3>What readers say</h3><div class="user-review"><p>Boring! I left after the gate.</p></div><div class="user-review"><p>I wept, and I keep sheep.</p></div></div><div class="trailer-list"><a href="/t1">Trailer</a></div><div class="newsletter-box"><p>Films of the week, on Fridays.</p></div><div class="copyright-line">Screen weekly, all rights reserved</div></body>""",
]
