import time

import pytest

from emberlake.llm import html_text as H

LONG = "This is the text of a page that has been written for the people who are going to read it, and it is as long as it has to be. " * 2

CASES = [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<article><h1>A &amp; B</h1><p>x<b>y</b>\n z<br>w&nbsp;v<p>Be.</article>", "A & B xy z w v Be."),
    ("<nav><ul><li><a href=/>menu</a></ul></nav><main><p>one</p><aside>no</aside><p>two</p></main><footer>&copy; no</footer>", "one two"),
    ("<header>site</header><article><header><h1>Title</h1></header><p>t</p><form>f<input></form><div class='comments'>c</div></article>", "Title t"),
    ("<article><p>x<script>if (a<b && c=='</p>') {}</script>y<style>p{}</style><!-- no --><noscript>n</noscript></article>", "xy"),
    ("<div class='cookie-notice'>We use cookies</div><div id=\"content\"><p>Short.</p></div><div class=ad>buy</div>", "Short."),
    ("<article><p>caf&eacute; &#233; &#xe9; &lt;b&gt; &unknown; &am", "café é é <b> &unknown; &am"),
    ("<article><p>x<p>y<div><a>m1</a></div><div><a>m2</a></div><div><a>m3</a></div><p><a>link</a></article>", "x y"),
    ("<article><p>x <a href='u'>linked</a> y</p></article><div>outside</div>", "x linked y"),
    ("<article><p>cut <b>off</b> her<a hr", "cut off her"),
    ("<p title='a>b'>c</p><p title=\"open>d</p>", "c d"),
    ("x < y and z > w", "x < y and z > w"),
    (f"<div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>", f"{LONG.strip()} Short one. {LONG.strip()}"),
    (f"<ul><li><a>Home</a></li><li><a>News</a></li></ul><p>Share</p><div><a>Privacy</a> <a>Terms</a></div><p>{LONG}</p>", LONG.strip()),
    ("<div class=site-header>no</div><article><div class='entry-header'><h1>Title</h1></div><p>t</p><div class=post-footer>no</div></article>", "Title t"),
    ("<title>no</title><body><div hidden>no</div><p>yes</p>", "yes"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_pages(source, text):
    assert H.main_text(source) == text


def test_undecided_blocks_follow_the_nearest_decided_ones():
    text = H.Block(LONG, 0, False, False)
    link, short = H.Block("x" * 80, 80, False, False), H.Block("Short.", 0, False, False)
    assert H.labels([text, short, short, short, link]) == ["text", "text", "text", "boilerplate", "boilerplate"]
    assert H.labels([short]) == ["text"]


@pytest.mark.parametrize("source", ["<a" * 20000, "<p " * 20000, "<!--" * 20000, "<p>" * 20000 + "x", "<div>" * 20000 + "x", "</b>" * 20000, "<script>" * 5000, "<a b=\"" * 20000, "&" * 50000])
def test_odd_markup_costs_linear_time(source):
    import time

    start = time.time()
    H.main_text(source)
    assert time.time() - start < 10


def test_frames(spark):
    rows = [(1, "u", None, 0), (None, None, "<article>é x</article>", 0), (2, "u", "", 0), (2, "u", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [("1", "u", "", 0), ("2", "u", "", 0), ("2", "u", "", 0), ("None", None, "é x", 3)]
    assert H.extract(df.limit(0)).count() == 0


def test_whole_pages(spark):
    """Synthetic pages hold their text in one article of headings and paragraphs."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html or "" for r in pages.collect()}
    for r in H.extract(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|<[^<>]*\Z|\Z)", source[r.page_id], re.S)
        plain = re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", body[1] if body else ""))
        assert r.text == re.sub(r"\s+", " ", html.unescape(plain)).strip() and r.n_chars == len(r.text)


LINKS = "<p><a>" + "Partner offer number seven click here " * 4 + "</a></p>"
OFFER = " ".join(["Partner offer number seven click here"] * 4)


def test_rules_run_inside_and_outside_of_an_article():
    """The article is a prior: both passes judge its blocks and those beside it."""
    assert H.main_text(f"<article><p>{LONG}</p>{LINKS}<p>Ad</p>{LINKS}<p>{LONG}</p></article>") == f"{LONG.strip()} {LONG.strip()}"
    assert H.main_text(f"<article><p>Teaser</p></article><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>") == f"Teaser {LONG.strip()} Short. {LONG.strip()}"
    assert H.main_text(f"<article><p>{LONG * 3}</p></article><p>{LONG}</p><p>Short.</p>") == f"{LONG.strip()} " * 3 + LONG.strip()
    assert H.main_text(f"<article><p>{LONG}</p><p>{'Zażółć gęślą jaźń. ' * 20}</p></article>").endswith("jaźń.")


@pytest.mark.parametrize("mark", ["site has-sidebar", "content no-sidebar", "post comments-open", "page with-menu"])
def test_words_in_a_wrapper_of_the_page_do_not_mark_its_text(mark):
    side = "<div class=sidebar><p>About us</p></div>"
    comments = f"<div class=comments><article class=comment><p>{LONG}</p></article></div>"
    assert H.main_text(f"<div class='{mark}'>{side}<article><h1>Title</h1><p>t</p></article></div>") == "Title t"
    assert H.main_text(f"<div class='{mark}'><div class='{mark}'><p>{LONG}</p><p>Short one.</p></div>{side}</div>") == f"{LONG.strip()} Short one."
    assert H.main_text(f"<main><div class='{mark}'><article><p>{LONG * 2}</p></article></div></main>") == (LONG * 2).strip()
    assert H.main_text(f"<article><div class='{mark}'><p>{LONG}</p></div><div class=comments>no</div></article>") == LONG.strip()
    assert H.main_text(f"<article><p>{LONG}</p><div class=comments><p>{LONG * 2}</p></div></article>") == LONG.strip()
    assert H.main_text(f"<main><article><p>{LONG * 2}</p></article>{comments}</main>") == (LONG * 2).strip()
    assert H.main_text(f"<div class=ad>{LONG[:90]}</div><article><p>Short text.</p></article>") == "Short text."
    assert H.main_text(f"<article><h1>Title</h1><div class='{mark}'><p>{LONG}</p></div></article>") == f"Title {LONG.strip()}"


def test_nested_wrappers_cost_linear_time():
    import time

    start = time.time()
    H.main_text("<div class=no-sidebar><p>x" * 20000)
    assert time.time() - start < 10


MENU = "<ul><li><a href='/1'>{0}</a></li><li><a href='/2'>{1}</a></li><li><a href='/3'>{2}</a></li></ul>"
PROSE = {
    "pl": ("Start Aktualności Kontakt", "W nocy z soboty na niedzielę strażacy gasili pożar lasu na południe od miasta. Ogień pojawił się po zachodzie słońca i szybko objął suche zarośla na zboczu. Do akcji ruszyło dwanaście zastępów, a mieszkańcy trzech wsi opuścili domy. Nad ranem sytuacja była opanowana, jednak dogaszanie potrwa do wieczora, bo wiatr wciąż roznosi iskry na sąsiednie pola i na skraj lasu."),
    "it": ("Inizio Notizie Contatti", "Nella notte tra sabato e domenica i vigili del fuoco hanno spento un incendio a sud della città. Le fiamme sono partite dopo il tramonto e hanno raggiunto in poco tempo la macchia secca della collina. Sul posto sono arrivate dodici squadre, mentre gli abitanti di tre paesi hanno lasciato le case. All'alba la situazione era sotto controllo, ma la bonifica durerà fino a sera."),
    "ru": ("Главная Новости Контакты", "В ночь на воскресенье пожарные тушили лесной пожар к югу от города. Огонь появился после захода солнца и быстро охватил сухой кустарник на склоне. На место прибыли двенадцать расчётов, а жители трёх деревень покинули дома. К утру пожар взяли под контроль, но тушение продлится до вечера, потому что ветер всё ещё разносит искры на соседние поля."),
    "zh": ("首页 新闻 联系", "星期六夜里，消防队员在城市南面扑灭了一场森林大火。火是在日落以后出现的，很快就烧到了山坡上干燥的灌木丛。十二支队伍赶到现场，三个村子的居民离开了家。到了早晨，火势得到控制，但是清理工作要持续到晚上，因为风还在把火星吹到附近的田里。人们希望明天下雨，这样树林的边缘就不会再次起火。"),
    "en": ("Home News Contact", "During the night from Saturday to Sunday the brigade put out a fire to the south of the town. The flames came up after sunset and soon reached the dry bushes on the hill. Twelve crews were sent to the place and the people of three villages left their houses. In the morning the fire was under control, but the work will go on until the evening because of the wind."),
}


@pytest.mark.parametrize("language", PROSE)
@pytest.mark.parametrize("paragraphs", [1, 2])
def test_long_texts_of_any_language_survive_a_menu_without_an_article(language, paragraphs):
    menu, prose = PROSE[language]
    body = "".join(f"<p>{prose}</p>" for _ in range(paragraphs))
    page = f"<html><body>{MENU.format(*menu.split())}<div>{body}</div>{MENU.format(*menu.split())}</body></html>"
    assert H.main_text(page) == " ".join([prose] * paragraphs)


def test_end_tags_are_implied_at_any_depth():
    deep = "<b>" * 40
    assert H.blocks(f"<div><p>{deep}one<p>two") == H.blocks(f"<div><p>{deep}one{'</b>' * 40}</p><p>two</p></div>")
    began = time.process_time()
    H.blocks("<li><div>" + "<b>" * 20_000 + "<li>x" * 20_000)
    assert time.process_time() - began < 10
