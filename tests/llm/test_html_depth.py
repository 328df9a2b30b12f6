from sentrylake.llm import html_template as ht


def test_deep_elements_close_what_they_opened():
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    assert ht.main_text(f"<div><article><p>before</p>{deep}<p>after</p></article></div><p>outside</p>") == "before\ndeep\nafter"
    inside = "<div>" * 300 + "<nav>menu</nav><form>form</form>text" + "</div>" * 300
    assert ht.main_text(f"<article>{inside}</article>") == "text"
