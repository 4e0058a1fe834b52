"""URL templates that differ far down a path."""

from factloom.llm import url_filters


def test_templates_that_differ_on_the_sixth_level(spark):
    rows = [(f"/a/b/c/d/e/{w}/{k}.html", v) for w, v in (("ads", "block"), ("news", "allow")) for k in range(30)] + [("/a/b/c/d/e/ads/77.html", None), ("/a/b/c/d/e/news/5.html", None)]
    rows += [("/" + "/".join(["deep"] * 200), None), ("/a/b/c/d/e/other/x/y/z", None)]
    urls = spark.createDataFrame([("h", p, v) for p, v in rows], "host string, path string, verdict string")
    got = {r["shape"]: (r.template, r.rejected) for r in url_filters.templates(urls).collect()}
    assert got["a/b/c/d/e/ads/*.html"] == ("a/b/c/d/e/ads/*.html", True) and got["a/b/c/d/e/news/*.html"] == ("a/b/c/d/e/news/*.html", False)
    assert got["/".join(["deep"] * 200)] == ("/".join(["deep"] * 200), False) and got["a/b/c/d/e/other/x/y/z"][1] is False
