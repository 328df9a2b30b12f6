import random

from sentrylake.llm import html_template as ht

from .helpers import text


def page(r, body, foot="(c) host", note="Subscribe to our letters today"):
    paragraphs = "".join(f"<p>{p}</p>" for p in body)
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=x1>{note}</div><article><h1>Head &amp; tail</h1>{paragraphs}</article><footer>{foot}</footer></body></html>"


def test_article_pages():
    html = page(random.Random(1), ["One <b>two</b>\n three", "a&nbsp;b<br>c", ""])
    assert ht.main_text(html) == "Head & tail\nOne two three\na b c"


def test_cut_pages_and_odd_markup():
    assert ht.main_text("") == ""
    assert ht.main_text("plain") == "plain"
    assert ht.main_text("<article><p>whole</p><p>cut sh") == "whole\ncut sh"
    assert ht.main_text("<article><p>whole</p><p clas") == "whole"
    assert ht.main_text("<article><p>a<!-- x <p>b</p> --> c<p>d<div>e</div></article>") == "a c\nd\ne"
    assert ht.main_text("<article><p>a</p><section class='comments'><p>rude</p></section><aside>s</aside><form>f</form></article>") == "a"
    assert ht.main_text("<main><p>1 < 2 &lt; 3</p></main>") == "1 < 2 < 3"
    assert ht.main_text("<body><div id='sidebar'>s</div><p>t</p><div class='cookie-notice'>n</div><ul><li>u<li>v</ul></body>") == "t\nu\nv"
    assert ht.main_text("<article><script>x</script>" + "<b>" * 500 + "deep") == "deep"


def test_templates_of_hosts(spark):
    r = random.Random(2)
    rows = []
    for i in range(8):
        body = "".join(f"<div class=c><p>{text(r, 30)}</p></div>" for _ in range(r.randint(1, 3)))
        rows.append((i, "https://One.example.org:80/x", f"<html><body><div class=top><span>Read this paper every day</span></div>{body}<div class=end>All rights kept</div></body></html>"))
    rows += [(20, "http://two.example.org/", "<body><p>alone</p></body>"), (21, None, None), (22, "nohost", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string").repartition(3)
    out = ht.extract(df).collect()
    assert len(out) == len(rows)
    by = {x.page_id: x for x in out}
    assert by[20].text == "alone" and by[21].text == "" and by[21].n_chars == 0 and by[22].text == ""
    for i, _, html in rows[:8]:
        assert "Read this paper" not in by[i].text and "All rights" not in by[i].text
        assert by[i].text.count("\n") == html.count("<p>") - 1 and by[i].n_chars == len(by[i].text)
    assert ht.extract(df.limit(0)).count() == 0


def test_copied_articles_are_not_template(spark):
    html = page(random.Random(3), ["Same words here", "and there"])
    df = spark.createDataFrame([(i, "http://h.example.org/", html) for i in range(6)], "page_id long, url string, html string")
    assert {x.text for x in ht.extract(df).collect()} == {"Head & tail\nSame words here\nand there"}


def test_against_a_plain_reading_of_the_pages_table(spark):
    """For pages of this table's make the article is what stands between two tags."""
    import html as h
    import re

    path = "/root/testdata/sf0.001"
    for x in ht.extract(spark.read.parquet(f"{path}/pages.parquet")).join(spark.read.parquet(f"{path}/pages.parquet").select("page_id", "html"), "page_id").collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", x.html, re.S)
        body = re.sub(r"</?b>", "", re.sub(r"<[^>]*\Z", "", m[1]).replace("<br>", " "))
        parts = (" ".join(h.unescape(q).split()) for q in re.split(r"</?(?:p|h1)>", body))
        assert x.text == "\n".join(q for q in parts if q)
