"""Invented web pages whose blocks are labelled by hand: data-keep="1" is article text, "0" is not.

A label holds for the element and what it contains. They are the training table of the main-text classifier.
"""

_S = "Morning light fell on the quiet harbour while the boats came back one after another from the open sea."
_L = " ".join([_S] * 3)

PAGES = [
    # semantic elements, short and long paragraphs
    f"""<body><nav data-keep="0"><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul></nav>
    <div class="ad" data-keep="0">Buy two tickets for the summer fair now and save.</div>
    <article data-keep="1"><h1>The harbour in the morning</h1><p>{_S}</p><p>Quiet.</p><p>{_L}</p><p>Boats came.</p><p>{_S}</p></article>
    <footer data-keep="0">&copy; harbour.example &middot; All rights reserved by the owners.</footer></body>""",
    f"""<body><header data-keep="0"><p>The Daily Wave</p><p>News from the coast since long ago, every morning</p></header>
    <main data-keep="1"><h1>Storm</h1><p>{_L}</p><ul><li>wind from the west</li><li>rain</li></ul><p>End.</p>
    <section class="comments" data-keep="0"><h3>Comments</h3><p>{_S}</p><p>Nice.</p></section></main>
    <aside data-keep="0"><p>Related</p><p>{_S}</p><ul><li><a href="/x">More about storms</a></li></ul></aside></body>""",
    # class names only
    f"""<body><div id="menu" data-keep="0"><a href="/a">One</a> <a href="/b">Two</a></div>
    <div class="content" data-keep="1"><h2>A walk</h2><p>{_S}</p><p>Then rest.</p><p>Some <a href="/l">linked words</a> in a sentence that goes on for a while.</p></div>
    <div class="sidebar" data-keep="0"><p>{_S}</p><p>Popular</p></div>
    <div id="footer" data-keep="0"><p>Contact us by letter.</p></div></body>""",
    f"""<body><div class="cookie-notice" data-keep="0"><p>We use cookies to make this site better for all of our readers, please agree.</p></div>
    <div class="post" data-keep="1"><h1>Bread</h1><p>Flour, water, salt.</p><p>{_L}</p><blockquote>Bread is life.</blockquote><p>Bake.</p></div>
    <div id="comments" data-keep="0"><p>{_L}</p><p>Thanks!</p></div>
    <form data-keep="0"><p>Leave your name and a message here.</p></form></body>""",
    # nothing is named: word counts and links must do
    f"""<body><div><div data-keep="0"><a href="/a">Start</a></div><div data-keep="0"><a href="/b">Archive of the paper</a></div><div data-keep="0"><a href="/c">About</a></div></div>
    <div><h1 data-keep="1">Old mill</h1><p data-keep="1">{_L}</p><p data-keep="1">{_S}</p><p data-keep="1">The wheel turned slowly.</p><p data-keep="1">{_S}</p></div>
    <div data-keep="0"><a href="/n">Next page</a></div><div data-keep="0">Printed in town</div></body>""",
    f"""<body><p data-keep="1">{_L}</p><p data-keep="1">{_S}</p><p data-keep="1">Short one here.</p><p data-keep="1">{_L}</p></body>""",
    f"""<body><table><tr><td data-keep="0"><a href="/1">News</a></td><td data-keep="0"><a href="/2">Weather today</a></td></tr></table>
    <p data-keep="1">{_S}</p><p data-keep="1">{_L}</p><p data-keep="0"><a href="/3">Read the next story about mills</a></p></body>""",
    # notices and adverts inside the article
    f"""<body><nav data-keep="0"><a href="/">Home</a></nav><article data-keep="1"><header><h1>Night train</h1></header><p>{_S}</p>
    <div class="advert" data-keep="0"><p>New shoes for long walks at half the price, only this week.</p></div><p>{_L}</p><p>It left.</p>
    <div class="share" data-keep="0"><a href="/s">Share</a></div><div class="newsletter" data-keep="0"><p>Get our letter every week.</p></div></article>
    <footer data-keep="0"><p>{_S}</p><p>Imprint</p></footer></body>""",
    f"""<body><div class="header" data-keep="0"><p>Site of the hill club</p></div><div class="banner" data-keep="0"><p>{_S}</p></div>
    <article data-keep="1"><h1>Hills</h1><p>Up.</p><p>Down.</p><p>{_S}</p><p><a href="/m">Map</a></p><h2>Way back</h2><p>{_L}</p></article>
    <div class="related" data-keep="0"><p>{_S}</p></div><div data-keep="0"><p>Some words behind the article that nobody wrote for it.</p></div></body>""",
    f"""<body><p data-keep="0">Skip to the text</p><article data-keep="1"><p>{_S}</p></article><p data-keep="0">{_S}</p></body>""",
    f"""<body><div data-keep="0">Welcome</div><main data-keep="1"><p>One.</p><p>Two words.</p></main><div data-keep="0">{_L}</div></body>""",
    # the article has no name, what stands beside it has
    f"""<body><div class="menu" data-keep="0"><p>{_S}</p></div><h1 data-keep="1">Lake</h1><p data-keep="1">{_L}</p><p data-keep="1">Deep water.</p>
    <div class="sidebar" data-keep="0"><p>{_L}</p><p>Boats for hire</p></div><p data-keep="1">{_S}</p><footer data-keep="0"><p>{_S}</p></footer></body>""",
    f"""<body><header data-keep="0"><p>{_S}</p></header><div><p data-keep="1">{_S}</p><p data-keep="1">Snow fell.</p><p data-keep="1">{_L}</p></div>
    <form data-keep="0"><p>{_S}</p></form><div class="comments" data-keep="0"><p>{_L}</p><p>{_S}</p></div></body>""",
    # the article has a name, so what has none is not part of it
    f"""<body><div data-keep="0"><p>Welcome to our pages</p><p>{_S}</p><p>Open daily</p></div><article data-keep="1"><h1>Sea</h1><p>{_S}</p><p>Salt.</p></article>
    <div data-keep="0"><p>{_L}</p><p>Call us</p><p>{_S}</p></div></body>""",
    f"""<body><p data-keep="0">{_L}</p><p data-keep="0">Menu of the day</p><p data-keep="0">{_S}</p><main data-keep="1"><p>Short.</p><p>{_L}</p><p>Also short.</p></main>
    <p data-keep="0">{_S}</p><p data-keep="0">Thanks for reading</p><p data-keep="0">{_L}</p></body>""",
]
