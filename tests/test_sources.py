"""Feeds and reference files."""

import gzip

from wardline.sources import feeds


def test_line_and_domain_feeds(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("http://a.example/x\n# note\nhttp://a.example/x\nftp://b\n")
    with gzip.open(tmp_path / "domains.txt.gz", "wt") as f:
        f.write("*.Evil.example # seen\nnodot\nwith space.example\na/b.example\n")
    assert [tuple(r) for r in feeds.read_line_feed(spark, str(tmp_path / "lines.txt"), "f").collect()] == [("url", "http://a.example/x", "f")]
    assert [r["value"] for r in feeds.read_domain_feed(spark, str(tmp_path / "domains.txt.gz"), "f").collect()] == ["evil.example"]


def test_csv_and_json_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text('# comment\n"1","2024","http://a.example","online"\n"2","2024","http://b.example","offline"\n')
    (tmp_path / "f.json").write_text('{"url": "http://c.example"}\n{"url": null}\n')
    assert [r["value"] for r in feeds.read_csv_feed(spark, str(tmp_path / "f.csv"), "f").collect()] == ["http://a.example"]
    assert [r["value"] for r in feeds.read_json_feed(spark, str(tmp_path / "f.json"), "f").collect()] == ["http://c.example"]


def test_rank_suffix_confusable_and_brand_files(spark, tmp_path):
    (tmp_path / "rank.csv").write_text("1,google.com\n2,mail.google.com\n3,b.org\n")
    (tmp_path / "psl.dat").write_text("// note\ncom\n*.ck\n!www.ck\n")
    (tmp_path / "conf.txt").write_text("# note\n0430 ;\t0061 ;\tMA\n0061 0062 ; 0063 ; MA\n")
    (tmp_path / "brands.json").write_text('[{"id": "g", "name": "Google", "category": "tech", "domains": ["google.com", "gmail.com"]}]')
    assert {r["registrable"]: r["rank"] for r in feeds.read_rank_list(spark, str(tmp_path / "rank.csv")).collect()} == {"google.com": 1, "b.org": 3}
    assert {tuple(r) for r in feeds.read_suffix_list(spark, str(tmp_path / "psl.dat")).collect()} == {("com", "exact"), ("ck", "wildcard"), ("www.ck", "exception")}
    assert [tuple(r) for r in feeds.read_confusables(spark, str(tmp_path / "conf.txt")).collect()] == [("0430", "0061")]
    assert {r["domain"] for r in feeds.read_brands(spark, str(tmp_path / "brands.json")).collect()} == {"google.com", "gmail.com"}


def test_merge_counts_new_rows_once(spark):
    old = spark.createDataFrame([("url", "a", "f")], "ioc_type string, value string, source string")
    new = spark.createDataFrame([("url", "a", "f"), ("url", "b", "f"), ("url", "b", "f"), ("url", "a", "g")], old.schema)
    merged, counts = feeds.merge_iocs(old, new)
    assert merged.count() == 3 and {r["source"]: r["n_new"] for r in counts.collect()} == {"f": 1, "g": 1}
