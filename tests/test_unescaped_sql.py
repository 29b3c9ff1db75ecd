import random
from html import unescape
from html.entities import html5

import duckdb

from tidewrack.plans import extended

SAID = ["", "a &amp", "&ampx &AMP;&notit; &notin; &ltimes;&lt=&lt;", "&#65;&#x41&#X41;&#0;&#13;&#128;&#x9f;&#129;&#1;&#127;&#xD800;&#1114112;&#99999999999999999999999;&#0000000000000000000000065;", "&#x000000000000000000000041;&#xffffffffffffffffff;", "& && &# &#x; &#; &x &; &am &quo", "&amp;lt; &amplt; &#38;lt;", "&nbsp; &apos;&#39;", "&NotEqualTilde;&NewLine;&Tab;&fjlig;é&eacuteé", "&#xFFFE;&#64976;&#65534;&#x1F600"]


def test_sql_resolves_references_as_html_does():
    r = random.Random(2)
    parts = [*html5, "#", "#x", "12", "41", ";", "&", " ", "x", "<", "é"]
    said = SAID + [f"&{n}" for n in html5] + ["".join(r.choice(["&", ""]) + r.choice(parts) for _ in range(6)) for _ in range(2000)]
    with duckdb.connect() as c:
        c.execute("CREATE TABLE t (k INTEGER, said VARCHAR)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(k, x) for k, x in enumerate(SAID)])
        c.execute("INSERT INTO t SELECT unnest(range(?, ?)), unnest(?)", [len(SAID), len(said), said[len(SAID) :]])
        got = [x for (x,) in c.execute(f"SELECT {extended._unescaped('said')} FROM t ORDER BY k").fetchall()]
    assert [(x, g) for x, g in zip(said, got) if g != unescape(x)] == [] and len(got) == len(said)


def test_cut_references_agree_with_the_sql(spark, tmp_path):
    pages = [(k, f'<html lang="en"><head><title>{t}</title></head><body><article><p>{t} and more words of a paragraph, with commas, to be its text.</p></article></body></html>') for k, t in enumerate(["fish &amp", "fish&amp;chips &#x27", "a&nbsp;&#8195;b &copy", "&amp;amp &lt"])]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    queries, sql = extended.registry.queries(), extended.registry.oracle_sql()
    for name in ("html_titles", "main_texts"):
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
            want = sorted(c.execute(sql[name]).fetchall())
        assert sorted(map(tuple, queries[name](spark, str(tmp_path)).collect())) == want
