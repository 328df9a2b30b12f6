from sentrylake.llm import html_template as ht


def test_copies_of_a_page_are_one_page(spark):
    html = "<p>x</p>" * 40
    rows = [(i, "http://a.example/1", html) for i in range(4)] + [(9, "http://a.example/9", "<p>other</p>")]
    rows += [(20 + i, None, f"<div><p>same text</p></div><p>own {i}</p>") for i in range(4)]
    out = {x.page_id: x.text for x in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(out[i] == "\n".join(["x"] * 40) for i in range(4)) and out[9] == "other"
    assert all(out[20 + i] == f"same text\nown {i}" for i in range(4))
