"""The words of the URL rules, as the contract lists them."""

from skeinwork.llm import url_filter


def test_each_rule_has_its_word(spark):
    want = {"http://a.com/en/1": "block", "http://x.example.com/en/75": "allow", "http://a.net/de/1": "allow", "http://example.net/de/7": "allow", "http://example.net/de/81": "block", "http://org/es/": "block"}
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(want)], "page_id long, url string, html string")
    assert [r.verdict for r in sorted(url_filter.judged(df).collect(), key=lambda r: r.page_id)] == list(want.values())
