"""Queries against their SQL on rows that the small tables don't hold."""

import duckdb
from pyspark.sql import functions as F

from plotwright.plans.catalogue import ORACLES, QUERIES


def same(spark, name, folder, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    found, want = QUERIES[name](spark, str(folder)).toArrow(), con.execute(ORACLES[name]).to_arrow_table()
    rows = lambda t: sorted(map(repr, zip(*(t[n].to_pylist() for n in sorted(t.column_names)))))
    assert rows(found) == rows(want) and found.num_rows


def test_page_titles(spark, tmp_path):
    """references other than the ampersand's, one cut off, blanks of all kinds, no page."""
    pages = [
        "<title>a &quot;b&quot; &amp; c &amp</title><a href=\"/x\">1</a><script>'<a href=\"/y\">'</script><a>2</a><a class=\"k\" href=\"/z\">3</a>", "<title>  a\t\tb  </title>", "<title>a\x0bb\x85\r c</title>",
        "<title>a\nb</title>", "<title>no end", "<TITLE>A</TITLE>", "", None, "<title></title><title>b</title>",
    ]
    same(spark, "page_titles", tmp_path, pages=spark.createDataFrame([(i, "http://a.test/1", h) for i, h in enumerate(pages)], "page_id long, url string, html string"))


def test_planted_clauses(spark, tmp_path):
    """a sentence that cuts another's figure leaves an area of 0."""
    text = spark.read.parquet("/root/testdata/check_s/documents.parquet").where("doc_id = 46941")
    short = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"))
    same(spark, "planted_clauses", tmp_path, documents=text.select("doc_id", "text").unionByName(short))


def test_url_classes(spark, tmp_path):
    """F8: keys of five digits and more stand in every shape."""
    ids = [base + i for base in (60_000, 99_990, 123_456, 999_990, 1_999_990, 7_654_321) for i in range(40)]
    part = spark.createDataFrame([(i, "Brand#7") for i in ids], "p_partkey long, p_brand string")
    pages = spark.createDataFrame([(1, "http://a.test/en/7817?x=1", "")], "page_id long, url string, html string")
    same(spark, "url_classes", tmp_path, part=part, pages=pages)


def plan_of(spark, name, folder):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(50)
    part.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return QUERIES[name](spark, str(folder))


def test_judge_answers_reads_each_answer_once(spark, tmp_path):
    """a text is parsed once a column that needs it, and a table of one file is dealt over the cores."""
    plan = plan_of(spark, "judge_answers", tmp_path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 4 and "Repartition 4" in plan


def test_object_rules_is_dealt_over_the_cores(spark, tmp_path):
    """a table of one file is dealt over the cores before texts are compared."""
    assert plan_of(spark, "object_rules", tmp_path)._jdf.queryExecution().optimizedPlan().toString().count("Repartition 4") == 2
