import random

from sentrylake.llm import html_template as ht

from .helpers import text

SCHEMA = "page_id long, url string, html string"


def site(seed, n=9, wrap="div", extra=""):
    """Pages without article, main or telling names: the text and other varied sections."""
    r = random.Random(seed)
    rows, want = [], {}
    for i in range(n):
        body = [text(r, 25) for _ in range(r.randint(3, 6))]
        head = text(r, 5)
        links = "".join(f"<li>{text(r, 3)}</li>" for _ in range(r.randint(2, 5)))
        inner = f"<h2>{head}</h2>" + "".join(f"<p>{p}</p>" for p in body)
        rows.append((seed * 100 + i, f"https://s{seed}.example.org/{i}", f"<html><head><title>{head}</title></head><body><div class=q1>{links}</div><{wrap} class=q2>{inner}{extra}</{wrap}><div class=q3><span>{text(r, 8)}</span></div><p class=q4>Written by hand</p></body></html>"))
        want[seed * 100 + i] = "\n".join([head, *body])
    return rows, want


def test_slots_of_the_template_are_the_text(spark):
    rows, want = [], {}
    for seed in (1, 2, 3):
        a, b = site(seed)
        rows, want = rows + a, want | b
    out = {x.page_id: x.text for x in ht.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert out == want
    # without the template the other sections are text as well
    assert all(ht.main_text(html) != want[i] for i, _, html in rows)


def test_hosts_of_two_pages_have_no_template(spark):
    rows, want = site(4, 2)
    out = {x.page_id: x.text for x in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(want[i] in out[i] and "Written by hand" in out[i] for i in want)


def test_comments_within_the_slots(spark):
    rows, want = site(5, wrap="section", extra="<article class='comment'><p>so rude</p></article><div id=comments><p>ruder</p></div>")
    assert {x.page_id: x.text for x in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    rows, want = site(6, wrap="article", extra="<article class='comment'><p>so rude</p></article><form><p>send</p></form>")
    assert {x.page_id: x.text for x in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_a_form_around_the_page():
    page = "<form><div>menu</div><article><p>text</p><form><p>send</p></form></article></form>"
    assert ht.main_text(page) == "text"
    assert ht.main_text("<article><p>real</p></article><article class=\"comment\"><p>reader comment</p></article>") == "real"


def test_order_and_nesting_make_a_class_valid():
    e = lambda token, parent, words, **more: {"token": token, "name": "div", "main": False, "parent": parent, "valid": True, "words": words} | more
    tree = [e(0, 0, 0), e(1, 0, 0), e(2, 1, 30), e(3, 1, 500), e(4, 1, 100)]
    assert ht.container(tree) == 3
    assert ht.container([*tree[:3], e(3, 1, 500, valid=False), tree[4]]) == 1  # its words are those of the element around
    assert ht.container([*tree[:2], e(2, 1, 30, name="h1"), *tree[3:]]) == 1  # a heading beside it is part of the text
    assert ht.container([*tree[:4], e(4, 1, 100, main=True)]) == 4
    assert ht.container([]) == 0


def test_names_within_an_article_take_nothing_away():
    for page, want in (
        ('<article><div class="share-price"><p>Prices rose.</p></div><p class="related-work">Others tried.</p></article>', "Prices rose.\nOthers tried."),
        ('<article><p class="ad-hoc">A committee.</p><section id="notice-period"><p>Three months.</p></section></article>', "A committee.\nThree months."),
        ("<article><header><h1>The headline</h1></header><p>Body.</p></article>", "The headline\nBody."),
        ('<header><p>Site</p></header><main><p>Text.</p><div class="comments-list"><p>rude</p></div><div class="cookie-notice">n</div><nav>m</nav><footer>f</footer></main>', "Text."),
    ):
        assert ht.main_text(page) == want


def test_a_sentence_that_stands_in_every_body_is_text(spark):
    rows, want = site(7)
    rows = [(i, u, html.replace("</h2>", "</h2><p>As we said before.</p>")) for i, u, html in rows]
    want = {i: w.replace("\n", "\nAs we said before.\n", 1) for i, w in want.items()}
    assert {x.page_id: x.text for x in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_fixed_text_of_its_own_make_is_left_out(spark):
    rows, want = site(8)
    rows = [(i, u, html.replace("</h2>", "</h2><div class=zz>Read our letters</div>")) for i, u, html in rows]
    assert {x.page_id: x.text for x in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want
