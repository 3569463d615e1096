from __future__ import annotations

import pytest

from claimloom.llm.extract import extract, main_text

ARTICLE = "<h1>A  title &amp; more</h1><p>First <b>bold</b> words,\n with text.</p><p>Second&nbsp;one.<br>After.<p>Third"
TEXT = "A title & more\nFirst bold words, with text.\nSecond one. After.\nThird"
NOISE = (
    "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy this.</div>"
    "<div id='cookie-notice'>We use cookies.</div><script>var t=\"</p><p>x\";</script><form><label>Name</label></form>"
)
PAGES = [
    (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{NOISE}<article>{ARTICLE}</article><footer>(c) x</footer></body>", TEXT),
    (f"<body>{NOISE}<main>{ARTICLE}<aside>Side bar</aside></main><section class='comments'><p>Nice!</p></section>", TEXT),
    (f"<body><header><h2>Site</h2></header><article><header><h1>Head</h1></header><p>Body, of it.</p><div class='ad'>x</div></article>", "Head\nBody, of it."),
    (f"<body>{NOISE}<div class='post'>{ARTICLE}</div><div class='sidebar'><p>Else, where.</p></div>", TEXT),
    (f"<body><div>{NOISE}</div><article>{ARTICLE} is cut &am", TEXT + " is cut &am"),
    ("<article><p>x &lt;b&gt; 1 < 2 and <3</p></article>", "x <b> 1 < 2 and <3"),
    ("<article><p>open <a href='x' title='a > b'>link</a> end</p><p hidden>no</p><ul><li>one<li>two</ul></article>", "open link end\none\ntwo"),
    ("", ""), ("<nav>only</nav>", ""), ("plain words, no markup.", "plain words, no markup."), ("<p", ""), ("<!-- never closed", ""),
    ("<article><p>" + "long words, here. " * 100_000 + "</p></article>", ("long words, here. " * 100_000).strip()),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_without_article_element_short_paths_go():
    words = "Some long sentence, with many words. " * 5
    page = f"<body><div class='top'><span>Home</span></div><div class='box'><p>{words}</p><p>{words}</p><h2>Head</h2><p>End.</p></div><div class='low'>x</div></body>"
    assert main_text(page) == "\n".join([words.strip(), words.strip(), "Head", "End."])


def test_table(spark):
    rows = [(1, "u", PAGES[0][0], "x"), (1, "u", PAGES[0][0], "x"), (2, None, None, "x"), (None, "v", "", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("name", ["layout has-sidebar", "with-sidebar", "no-header", "widget-page", "page sidebar_right"])
def test_a_wrapper_with_a_listed_word_keeps_its_article(name):
    side = "<div class='sidebar'><p>Else, where.</p></div>"
    assert main_text(f"<body>{NOISE}<div class='{name}'><article>{ARTICLE}</article>{side}</div></body>") == TEXT
    assert main_text(f"<body>{NOISE}<div class='{name}'><div class='post'>{ARTICLE}</div>{side}</div></body>") == TEXT


def test_comments_go_even_if_longer_than_the_article():
    talk = "<section class='comments'>" + "<article class='comment'><p>A long remark, with words.</p></article>" * 20 + "</section>"
    assert main_text(f"<body><article>{ARTICLE}</article>{talk}</body>") == TEXT
    assert main_text(f"<body><article>{ARTICLE}{talk}</article></body>") == TEXT
