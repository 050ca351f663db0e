"""Readers/writers round trips, page extraction, streaming expansion, driver contract."""
import json
import os

import pytest

from varilens.operators import extract as H
from varilens.sources import readers, writers
from tests.conftest import SF_SMALL


def test_csv_parquet_json_round_trip(spark, scratch):
    df = spark.createDataFrame([("c1", "line one\nline \"two\""), ("c2", None)], "case_id string, case_text string")
    writers.write_raw_csv(df, f"{scratch}/csv")
    back = readers.load_csv(spark, f"{scratch}/csv", schema=df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    writers.write_variants(df, f"{scratch}/p.parquet")
    assert readers.load(spark, f"{scratch}/p.parquet").count() == 2
    with open(f"{scratch}/x.txt", "w") as fh:
        fh.write("x")
    with pytest.raises(ValueError):
        readers.load(spark, f"{scratch}/x.txt")


def test_link_index_reader(spark, scratch):
    path = f"{scratch}/links.json"
    with open(path, "w") as fh:
        json.dump([{"id": 0, "link": "u", "publication_year": "01_2015", "answer_idx": "A", "answer": "x"}], fh)
    r = readers.read_link_index(spark, path).first()
    assert r.link == "u" and r.publication_year == "01_2015"


SITE = H.Selectors(listing_item=("li", "article"), listing_link=("a", "article--title"),
                   container=("div", "article-full-text"), article_type=("div", "meta-article-type thm-col"),
                   quiz=("div", "box-section online-quiz clip-last-child thm-bg"),
                   quiz_title=("h4", "box-section--title"), quiz_answer=("p", "para"), answer_para=("p", "para"))

PAGE = """<html><body><ul><li class="article"><a class="article--title" href="/a1">T</a>
<div class="article--date meta-item no-wrap">March 5, 2014</div></li>
<li class="article"><a class="article--title" href="/old">T</a><div class="article--date meta-item no-wrap">May 1, 2010</div></li></ul>
<div class="meta-article-type thm-col">Clinical Challenge</div>
<div class="article-full-text"><p>Case</p><p>A man of fifty years came in with a long cough.</p>
<p>Short one.</p><div class="figure-table-image"><img src="x.png"></div>
<p>Diagnosis</p><p>Pneumonia of the left lower lobe was confirmed today.</p>
<p>Discussion</p><p>This is a discussion paragraph that has enough words.</p>
<div>Article Information</div><p>After the stop marker this is ignored entirely.</p></div>
<div class="box-section online-quiz clip-last-child thm-bg"><h4 class="box-section--title">What next?</h4>
<p class="para">A. Rest</p><p class="para">B. Antibiotics</p><p class="para">C. Surgery</p><p class="para">D. Nothing</p></div>
</body></html>"""


def test_extract_site_page(spark):
    pages = spark.createDataFrame([(1, "http://x/1", PAGE)], "page_id long, url string, html string")
    e = H.extract_pages(pages, SITE).first()
    assert [i.href for i in e.listing] == ["/a1", "/old"]
    assert e.case_paras == ["A man of fifty years came in with a long cough."]
    assert e.diagnosis == "Pneumonia of the left lower lobe was confirmed today."
    assert e.chosen_option == e.diagnosis
    assert e.discussion_paras == ["This is a discussion paragraph that has enough words."]
    assert e.has_image == "Yes" and e.article_type == "Clinical Challenge"
    assert e.mcq_title == "What next?" and e.mcq_answers[1] == "B. Antibiotics"
    lst = H.filter_year_cutoff(H.extract_listing(H.extract_pages(pages, SITE))).collect()
    assert [(r.link, r.publication_year) for r in lst] == [("/a1", "03_2014")]
    key = H.extract_answer_key(H.extract_pages(pages, SITE)).first()
    assert (key.answer_idx, key.answer) == ("A", "Rest")
    links = spark.createDataFrame([("http://x/1", "A", "Rest")], "link string, answer_idx string, answer string")
    case = H.assemble_raw_cases(H.extract_pages(pages, SITE), links).first()
    assert case.question == "A man of fifty years came in with a long cough. What next?"
    assert case.opd == "D. Nothing"


def test_stream_variants(spark, scratch):
    from varilens import schema as S
    from varilens.streaming.stream import stream_variants
    src = f"{scratch}/in"
    spark.createDataFrame([("c1", "A 30-year-old man.", "q", "a", "b", "c", "d", "A")], S.CASE_SCHEMA) \
        .write.parquet(src)
    q = stream_variants(spark, src, f"{scratch}/out", schema=S.CASE_SCHEMA, checkpoint=f"{scratch}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{scratch}/out").count() == 10


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) == {"llm", "ethnicity", "gender", "accuracy", "n"}
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_spread_deals_as_told(spark):
    from varilens.sources.readers import spread
    one = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    wide = spread(one, 4)
    assert wide.rdd.getNumPartitions() == 4 and wide.count() == one.count()


def test_sections_by_position(spark):
    def page(*parts):
        return "<article>" + "".join(p if p.startswith("<") else f"<p>{p}</p>" for p in parts) + "</article>"
    sel = H.Selectors(min_words=3)
    rows = [
        page("Case", "one two three", "short", "Diagnosis", "Gout", "What to Do Next", "Wait", "Discussion", "four five six"),
        page("Answer", "Diagnosis", "free words here", "Diagnosis", "Flu", "<div>Article Information</div>", "Diagnosis", "Late"),
        page("Diagnosis", "Flu", "Answer"), page(), "<p>no container here</p>",
        page("Discussion", "a b c", "Case", "d e f"),
    ]
    found = H.extract_pages(spark.createDataFrame(list(enumerate(rows)), "page_id long, html string").selectExpr("*", "'u' as url"), sel)
    got = [(r.diagnosis, r.chosen_option, r.case_paras, r.discussion_paras, r.paragraphs) for r in found.orderBy("page_id").collect()]
    assert got == [
        ("Gout", "Wait", ["one two three"], ["four five six"], ["one two three", "four five six"]),
        ("Flu", "Flu", [], [], ["free words here"]), ("Flu", "", [], [], []), ("", "", [], [], []), ("", "", [], [], []),
        ("", "", ["d e f"], ["a b c", "d e f"], ["a b c", "d e f"])]


def test_package_is_shipped_to_python_workers(spark):
    import zipfile
    from varilens.session import ship_package
    ship_package(spark)  # idempotent
    path = spark.sparkContext._varilens_zip
    names = zipfile.ZipFile(path).namelist()
    assert "varilens/operators/overlap.py" in names and "varilens/functions/porter.py" in names


def test_a_page_that_stops_the_parser_is_told(spark, monkeypatch):
    from varilens.functions import html as P

    def broken(self, tag, attrs):
        raise AssertionError("bad markup")
    root, error = P.parse("<p>fine</p>")
    assert error is None and root.find(("p", None)).text() == "fine"
    monkeypatch.setattr(P._Builder, "handle_startendtag", broken)
    root, error = P.parse("<p>kept</p><x/><p>lost</p>")
    assert error == "AssertionError: bad markup" and [n.text() for n in root.find_all(("p", None))] == ["kept"]
    e = H.extract_pages(spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "v", None)], "page_id long, url string, html string"))
    assert H.parse_errors(e).count() == 0
    shown = spark.createDataFrame([("x",), ("x",), (None,)], "parse_error string")
    assert [tuple(r) for r in H.parse_errors(shown).collect()] == [("x", 2)]


def test_pages_are_sent_on_in_small_slices():
    """Slices of neighbouring pages by bytes of markup; a NULL page counts nothing, a long one is its own slice."""
    import pyarrow as pa
    pages = pa.array(["ab", None, "cd", "efghij", "k", "é", "lm"])
    assert list(H._page_slices(pages, 4)) == [(0, 3), (3, 1), (4, 2), (6, 1)]
    assert list(H._page_slices(pages.slice(0, 0), 4)) == []


def test_parsed_tree_has_no_cycles():
    from varilens.functions.html import parse
    root, _ = parse("<p>a<b>c</b></p><div><i>d</i></div>")
    assert [n.parent for n in root.iter()] == [None] * 4


def test_partitioned_write_does_not_sort(spark, scratch):
    """Rows of all partition values stay in their order: no task sorts (and spills) them, and the setting is put back."""
    from pyspark.sql import functions as F
    df = spark.range(0, 5000, numPartitions=1).select((F.col("id") % 5).alias("p"), (F.col("id") * 7 % 5000).alias("v"))
    before = spark.conf.get(writers.CONCURRENT_FILES)
    writers.write_variants(df, f"{scratch}/v", partition_by="p")
    assert spark.conf.get(writers.CONCURRENT_FILES) == before
    import glob
    assert glob.glob(f"{scratch}/v/p=0/*.zstd.parquet")
    back = spark.read.parquet(f"{scratch}/v")
    assert back.count() == 5000 and {(r.p, r.v) for r in back.collect()} == {(i % 5, i * 7 % 5000) for i in range(5000)}
