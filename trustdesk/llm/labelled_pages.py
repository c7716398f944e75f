"""Written pages with their article marked by ``data-article``, in layouts that do not name it alike."""

WORDS = ("The river rose for three days before the town closed the lower bridge, and the market moved uphill. "
         "People carried what they could, said the baker, who kept her shop open until the lamps failed. "
         "By Friday the water had fallen again; only a brown line on the walls showed how high it had been.")
SENTENCES = [s.strip() + "." for s in WORDS.replace(";", ".").split(".") if s.strip()]
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Contact us", "About")) + "</ul>"
COOKIES = "We use cookies to improve your visit, to measure traffic and to show adverts that suit you."
PARAGRAPHS = "".join(f"<p>{WORDS if i % 2 else SENTENCES[i % len(SENTENCES)]}</p>" for i in range(5))
COMMENT = "I lived there as a child and remember it well, thank you for writing this down for all of us."

PAGES = [
    f'<html><head><title>x</title></head><body><header><a href="/">The Daily</a><nav>{MENU}</nav></header>'
    f'<div class="content" data-article="1"><h1>High water</h1>{PARAGRAPHS}<ul><li>Bridge closed.</li><li>Market moved.</li></ul></div>'
    f'<aside class="sidebar"><h3>Most read</h3>{MENU}<p>{SENTENCES[0]}</p></aside><footer><p>&copy; The Daily. All rights reserved.</p></footer></body></html>',
    f'<body><div id="cookie-notice"><p>{COOKIES}</p><button>Accept</button></div><div class="menu">{MENU}</div>'
    f'<div class="post" data-article="1"><h2>After the flood</h2>{PARAGRAPHS}<blockquote>{SENTENCES[1]}</blockquote></div>'
    f'<div class="comments"><h3>2 comments</h3><div class="comment"><p>{COMMENT}</p></div><div class="comment"><p>{SENTENCES[2]}</p></div></div>'
    f'<form><label>Name</label><input><label>Your comment</label><textarea>say something</textarea><button>Send</button></form>'
    f'<div class="footer">Copyright 2020. Terms. Privacy.</div></body>',
    f'<body><div class="banner ad">{SENTENCES[0]} Buy now!</div><table><tr><td class="left">{MENU}</td><td data-article="1"><h1>Water</h1>'
    f'{PARAGRAPHS}</td><td class="right"><p class="advert">{WORDS}</p></td></tr></table><p class="copyright">&copy; 2011 by us</p></body>',
    f'<body><main><div data-article="1"><h1>Old bridge</h1>{PARAGRAPHS}</div><section class="related"><h2>Related</h2>{MENU}</section>'
    f'<section id="comments"><p>{COMMENT}</p><p>{WORDS}</p></section></main><footer><nav>{MENU}</nav></footer></body>',
    f'<body><nav>{MENU}</nav><div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></div><section data-article="1">'
    f'<h1>Three days</h1><p>{WORDS}</p><p>{SENTENCES[2]} <a href="/x">More on the bridge</a>, {SENTENCES[1]}</p><pre>level 4.1 m</pre></section>'
    f'<div class="share"><a href="/t">Share</a> <a href="/m">Mail</a></div><div class="newsletter"><form><p>Sign up for our letter, every Friday.</p></form></div>'
    f'<div id="footer"><p>{SENTENCES[0]}</p><p>Imprint</p></div></body>',
    f'<body><article><header data-article="1"><h1>In the market</h1></header><div data-article="1">{PARAGRAPHS}</div>'
    f'<div class="ad"><p>{WORDS}</p></div><p data-article="1">{WORDS}</p><aside><p>{SENTENCES[0]}</p></aside>'
    f'<div class="comment-list"><p>{COMMENT}</p></div><form><p>{SENTENCES[1]}</p></form></article><div class="notice"><p>{COOKIES}</p></div></body>',
    f'<body><div class="notice cookie">{COOKIES} <a href="/c">More</a></div><nav>{MENU}</nav><div class="ad">{WORDS}</div></body>',
    f'<body><div class="header">{MENU}</div><div class="main-text" data-article="1"><p>{SENTENCES[0]}</p></div><div class="sidebar"><p>{WORDS}</p></div></body>',
]
