import duckdb
import pytest

from ridgeline.llm.url_filters import host_reputation, public_suffixes, registered, url_filter, url_filter_sql

COLUMNS = ["page_id", "host", "domain", "suffix", "n_labelled", "n_good", "posterior_mean", "upper_bound", "keep"]


def rows():
    out = []
    for i in range(300):
        host = ["good.example.org", "bad.example.org", "www.Fine.co.uk:80", "user@odd.co.uk", "lone.net"][i % 5]
        out.append((i, f"http://{host}/en/{i}", "x"))
    return out + [(900, None, "x"), (901, "", "x"), (902, "no url", "x"), (None, "http://lone.net/en/4", "x"), (4, "http://lone.net/en/4", "x"), (903, "http://never.seen.com/a", "x"), (904, "https://localhost/en/99999999999999999999", "x"), (905, "http://10.0.0.1/en/1", "x"), (906, "http://a.b.kawasaki.jp/", "x"), (907, "http://x.city.kawasaki.jp/" + "long/" * 20_000, "x")]


def tables(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, host string")
    labels = [(i, 0 if i % 5 == 1 else 1, 0) for i in range(200)] + [(3, None, 0), (None, 1, 0), (4, 0, 1), (0, 1, 0)]
    return pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("broadcast_hosts", [1000, 0])
def test_sql_gives_the_same(spark, broadcast_hosts):
    pages, labels = tables(spark)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    got = sorted((tuple(r[c] for c in COLUMNS) for r in url_filter(pages, labels, broadcast_hosts=broadcast_hosts).collect()), key=repr)
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({url_filter_sql()})").fetchall(), key=repr)
    assert [tuple(None if v != v else v for v in r) for r in got] == [tuple(None if v != v else v for v in r) for r in want]


def test_bad_hosts_go_and_the_unknown_stay(spark):
    pages, labels = tables(spark)
    keep = {r.page_id: r.keep for r in url_filter(pages, labels).collect()}
    assert not keep[1] and keep[0] and keep[900] and keep[902] and keep[903]
    h = {r.host: r for r in host_reputation(pages, labels).collect()}
    assert h["fine.co.uk"].suffix == "co.uk" and h["odd.co.uk"].domain == "odd.co.uk" and h["bad.example.org"].domain == "example.org"
    assert h["never.seen.com"].n_labelled == 0 and h["bad.example.org"].posterior_mean < 0.2 < h["good.example.org"].posterior_mean


def test_empty_tables(spark):
    pages, labels = tables(spark)
    assert url_filter(pages.where("false"), labels).count() == 0
    assert url_filter(pages, labels.where("false")).where("keep").count() == pages.count()


def test_registered_domains_follow_the_public_list(spark):
    known = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.c.kawasaki.jp": ("c.kawasaki.jp", "b.c.kawasaki.jp"), "x.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "x.www.ck": ("ck", "www.ck"), "a.b.ck": ("b.ck", "a.b.ck"), "lone": ("lone", "lone"), "a.unknown": ("unknown", "a.unknown"), "1.2.3.4": ("1.2.3.4", "1.2.3.4")}
    got = {r.host: (r.suffix, r.domain) for r in registered(spark.createDataFrame([(h,) for h in known], "host string")).collect()}
    assert got == known


def test_the_suffix_list_needs_no_library_of_sparks(monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark, "__file__", "/nowhere/pyspark/__init__.py")
    public_suffixes.cache_clear()
    rules = public_suffixes()
    assert {"co.uk", "*.kawasaki.jp", "!city.kawasaki.jp"} <= set(rules) and all("." in r and "'" not in r for r in rules)
    assert "co.uk" in url_filter_sql()
