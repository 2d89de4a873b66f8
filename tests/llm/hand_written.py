"""Hand-written pages of layouts that the extractor was not taught, with their main text."""

# ruff: noqa: E501
_P1 = "The river rose in the night and by morning the lower road was under water, so the market opened on the hill."
_P2 = "People carried what they could, and the baker sold bread from a cart until noon."
_P3 = "By evening the rain had stopped, and the council said that the bridge would open again on Friday."
_TEXT = f"River rises\n\n{_P1}\n\n{_P2}\n\n{_P3}"
_BODY = f"<h1>River rises</h1><p>{_P1}</p><p>{_P2}</p><p>{_P3}</p>"
PAGES = {
    "figure and time": (f'<body><main><article><header><h1>River rises</h1></header><p>{_P1}</p><figure><img src="a.jpg"></figure><p>{_P2}</p><p>{_P3}</p></article></main></body>', None),
    "dialog": (f"<body><article>{_BODY}<dialog open><p>Please accept our cookies before you go on.</p><button>Fine</button></dialog></article></body>", _TEXT),
    "hidden": (f'<body><div hidden><p>We changed our terms. Please read them before you go on with this.</p></div><article>{_BODY}</article><div aria-hidden="true"><p>Loading the next story for you</p></div></body>', _TEXT),
    "display none": (f'<body><article><h1>River rises</h1><p>{_P1}</p><div style="color:red; display: none"><p>Subscribe to read on, it costs less than a coffee.</p></div><p>{_P2}</p><p>{_P3}</p></article></body>', _TEXT),
    "hidden in a title": (f'<body><article><h1 title="hidden until noon">River rises</h1><p>{_P1}</p><p data-x="display:none">{_P2}</p><p>{_P3}</p></article></body>', _TEXT),
    "feedback": (f'<body><article>{_BODY}<div class="feedback"><h3>What people said</h3><div><p>I saw it from my window.</p></div><div><p>Glad that all are safe.</p></div><div><p>The bridge is too old.</p></div></div></article></body>', _TEXT),
    "readers' list": (f"<body><article>{_BODY}<section><h3>What readers say</h3><ul><li><b>Ann</b> <p>I saw it from my window.</p></li><li><b>Bob</b> <p>Glad that all are safe.</p></li></ul></section></article></body>", _TEXT),
    "voices after the article": (f'<body><article>{_BODY}</article><div id="voices"><h2>Voices</h2><div class="voice"><cite>Ann</cite><p>I saw it from my window.</p></div><div class="voice"><cite>Bob</cite><p>Glad that all are safe.</p></div></div></body>', _TEXT),
    "div soup": (f'<body><div id="p1"><div class="x7"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><div class="y9"><div class="z3">{_BODY}</div></div><div class="q2"><a href="/t">Terms</a> <a href="/k">Contact</a></div></div></body>', _TEXT),
    "sections": (f"<body><main><h1>River rises</h1><section><h2>Morning</h2><p>{_P1}</p></section><section><h2>Noon</h2><p>{_P2}</p></section><section><h2>Evening</h2><p>{_P3}</p></section></main></body>", f"River rises\n\nMorning\n\n{_P1}\n\nNoon\n\n{_P2}\n\nEvening\n\n{_P3}"),
    "list at the end": (f"<body><article>{_BODY}<p>What to bring:</p><ul><li>a torch and warm clothes</li><li>water for two days</li><li>the papers of the house</li></ul></article></body>", f"{_TEXT}\n\nWhat to bring:\n\na torch and warm clothes\n\nwater for two days\n\nthe papers of the house"),
    "table": (f"<body><article>{_BODY}<table><tr><th>Hour</th><th>Level</th></tr><tr><td>6</td><td>3.1 m</td></tr><tr><td>9</td><td>4.0 m</td></tr></table></article></body>", f"{_TEXT}\n\nHour\n\nLevel\n\n6\n\n3.1 m\n\n9\n\n4.0 m"),
    "quotation": (f"<body><article>{_BODY}<blockquote><p>We have never seen the water so high, and I have lived here all my life.</p></blockquote></article></body>", f"{_TEXT}\n\nWe have never seen the water so high, and I have lived here all my life."),
    "newsletter form": (f'<body><article><h1>River rises</h1><p>{_P1}</p><form action="/go"><p>Get our letter every morning</p><input name="mail"><button>Send</button></form><p>{_P2}</p><p>{_P3}</p></article></body>', _TEXT),
    "aside with teasers": (f'<body><div class="wrapper"><main><article>{_BODY}</article></main><aside><h2>More</h2><ul><li><a href="/1">Snow in the hills</a></li><li><a href="/2">New school opens</a></li></ul></aside></div></body>', _TEXT),
    "cards below": (f'<body><article>{_BODY}</article><div class="k3"><div class="card"><a href="/1"><h4>Snow in the hills</h4></a></div><div class="card"><a href="/2"><h4>New school opens</h4></a></div></div></body>', _TEXT),
    "script and entities": (f"<body><article><h1>River&nbsp;rises</h1><script>if (a < b) {{ c('<p>no</p>') }}</script><p>{_P1}</p><noscript><p>Turn scripts on</p></noscript><p>{_P2}</p><style>p{{}}</style><p>{_P3}</p></article></body>", _TEXT),
    "unclosed": (f"<body><article><h1>River rises</h1><p>{_P1}<p>{_P2}<p>{_P3}</article><footer><p>All rights kept by the paper</footer>", _TEXT),
    "legal footer": (f'<body><article>{_BODY}</article><footer><div><p>All rights kept. The paper is not liable for what others write on these pages, nor for pages that it links to.</p></div></footer></body>', _TEXT),
    "nested roles": (f'<body><div role="banner"><p>The Hill Paper</p></div><div role="navigation"><ul><li><a href="/">Home</a></li></ul></div><div role="main">{_BODY}</div><div role="contentinfo"><p>Printed on the hill</p></div></body>', None),
    "two comment levels": (f'<body><main>{_BODY}<div class="zz"><h3>Talk</h3><ol><li><p>I saw it from my window.</p><ol><li><p>So did I, from the church.</p></li></ol></li><li><p>Glad that all are safe.</p></li></ol></div></main></body>', _TEXT),
    "sponsored": (f'<body><article><h1>River rises</h1><p>{_P1}</p><div class="sponsored"><p>New boots, made for wet roads, now at half the price in every shop.</p></div><p>{_P2}</p><p>{_P3}</p></article></body>', _TEXT),
}
PAGES = {k: (h, _TEXT if t is None else t) for k, (h, t) in PAGES.items()}
