"""Rules without an ASCII token."""

from folioscope.llm import url_filter


def test_rule_without_token(spark):
    urls = ["http://пример.рф/", "http://a.пример.рф/x", "http://example.net/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rules = [url_filter.parse("block пример.рф/"), url_filter.parse("block example.net/")]
    for used, wanted in ((rules, ["block", "block", "block", "allow"]), (rules[:1], ["block", "block", "allow", "allow"])):
        found = url_filter.filter_pages(pages, used).collect()
        assert [r.verdict for r in sorted(found, key=lambda r: r.page_id)] == wanted
