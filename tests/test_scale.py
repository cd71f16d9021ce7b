"""What a row costs and what a task holds: values worked out once, batches by size."""

import pyarrow as pa
from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import names
from leadlens.operators import extraction, leads, page_tree, selection
from leadlens.plans import lead_queries
from leadlens.plans.page_queries import LIST_LINKS


def worked_out(df, what):
    """How often an expression stands in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def people(spark, *more):
    return spark.createDataFrame([("Ann", "Lee"), ("Ann", ""), (None, "Lee"), ("Bo", "Bo"), ("é", "A-b"), *more], "f string, l string")


def test_permutations_normalise_a_name_once(spark):
    df = people(spark).select(em.permutations(F.col("f"), F.col("l"), F.lit("last")).alias("p"))
    assert worked_out(df, "regexp_replace(") == 2
    got = [",".join(f"{x['pattern']}:{x['localpart']}" for x in r["p"]) for r in df.collect()]
    assert got[0] == "last:lee,first.last:ann.lee,first_last:ann_lee,firstlast:annlee,first:ann,flast:alee"
    assert got[1] == "first:ann" and got[2] == "last:lee" and got[4] == "last:ab"
    assert got[3] == "last:bo,first.last:bo.bo,first_last:bo_bo,firstlast:bobo,flast:bbo,firstl:bob"


def test_candidates_fold_names_once_and_drop_roles(spark):
    rows = people(spark, ("info", ""), ("no", "reply"))
    df = rows.select(em.candidates(F.col("f"), F.col("l"), F.lit(" X.example"), F.lower("f"), F.lower("l"), cap=20).alias("c"))
    assert worked_out(df, "regexp_replace(") <= 5  # two names, as given and folded, and the tag of an address
    got = [r["c"] for r in df.collect()]
    assert got[0][:3] == ["ann.lee@x.example", "ann_lee@x.example", "annlee@x.example"] and len(got[0]) == len(set(got[0]))
    assert "info@x.example" not in got[5] and "noreply@x.example" not in got[6] and "no.reply@x.example" in got[6]


def test_pattern_of_normalises_a_name_once(spark):
    df = spark.createDataFrame([("ann_lee", "Ann", "Lee"), ("bo", "Bo", "Bo"), ("x", "Ann", "Lee")], "x string, f string, l string").select(em.pattern_of(F.col("x"), F.col("f"), F.col("l")).alias("p"))
    assert worked_out(df, "regexp_replace(") == 2
    assert [r["p"] for r in df.collect()] == ["first_last", "first", None]


def test_pattern_of_builds_no_list_of_every_pattern(spark):
    rows = [("ann_lee", "Ann", "Lee"), ("lee", "Ann", "Lee"), ("leeann", "Ann", "Lee"), ("bob", "Bo", "Bo"), ("bo", "Bo", ""), ("lee", None, "Lee"), ("", "", ""), (None, "Ann", "Lee"), ("ann.lee", None, None)]
    df = spark.createDataFrame(rows, "x string, f string, l string").select(em.pattern_of(F.col("x"), F.col("f"), F.col("l")).alias("p"))
    assert worked_out(df, "array_position(") == 0 and worked_out(df, "filter(") == 0
    assert [r["p"] for r in df.collect()] == ["first_last", "last", "lastfirst", "firstl", "first", "last", None, None, None]


def test_titles_are_judged_once_whatever_filter_follows(spark, data):
    plan = lead_queries.search_filtered(spark, data)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    judged = [k for k, line in enumerate(plan) if "RLIKE" in line]
    assert len(judged) == 1 and "Aggregate [title" in plan[judged[0] + 1]  # on distinct titles, not on people or their addresses


def test_titled_people(spark):
    rows = [(1, "CEO"), (2, "CEO"), (3, None), (4, ""), (5, " vp, sales"), (6, None), (7, "Gardener")]
    got = leads.titled(spark.createDataFrame(rows, "id int, title string"))
    want = spark.createDataFrame(rows, "id int, title string").select("id", "title", *names.canonical_title(F.col("title")))
    assert got.columns == ["id", "title", "role_family", "seniority"] and sorted(map(str, got.collect())) == sorted(map(str, want.toDF(*got.columns).collect()))
    by_id = {r["id"]: (r["role_family"], r["seniority"]) for r in got.collect()}
    assert len(by_id) == 7 and by_id[3] == names.UNTITLED and by_id[5] == ("Sales", "VP")


def test_names_are_judged_on_values_worked_out_once(spark):
    df = spark.createDataFrame([("Jane Doe, CPA",), ("VP Sales",)], "s string").select(extraction.like_name(F.col("s")).alias("n"))
    assert worked_out(df, "regexp_replace(") < 40
    assert [r["n"] for r in df.collect()] == [True, False]


def test_pages_are_parsed_in_bunches_of_bounded_size():
    html = ["x" * 400_000] * 5 + [None, "y" * 3_000_000, "z"] + ["w"] * 450
    bunches = list(page_tree._bunches(pa.RecordBatch.from_arrays([pa.array(range(len(html))), pa.array(html)], ["page_id", "html"])))
    assert [i for b in bunches for i in b.column(0).to_pylist()] == list(range(len(html)))
    assert all(b.num_rows == 1 or (b.num_rows <= page_tree.BUNCH_PAGES and sum(len(h or "") for h in b.column(1).to_pylist()) <= page_tree.BUNCH) for b in bunches)
    assert list(page_tree._bunches(pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["page_id", "html"]))) == []


def test_a_list_of_one_is_repeated_siblings_only_with_links_beside(spark):
    one = "<main><ul><li><i>Ann Lee</i><i>VP Sales</i></li>{}</ul></main>"
    df = spark.createDataFrame([(0, one.format("")), (1, one.format(LIST_LINKS))], "page_id long, html string")
    got = {r["page_id"]: (r["name"], r["title"], r["kind"]) for r in extraction.cards(page_tree.trees(df)).collect()}
    assert got == {0: ("Ann Lee", "VP Sales", "card_item"), 1: ("Ann Lee", "VP Sales", "card_siblings")}


def test_folded_texts_keep_order_and_nulls():
    texts = ["ÉT  é", None, "", "Plain  Text\t"] * 40
    got = names._folded(pa.chunked_array([pa.array(texts)]).combine_chunks())
    assert got.to_pylist() == ["et e", None, "", "plain text"] * 40 and names._folded(pa.array([], pa.string())).to_pylist() == []


def test_ties_of_the_prefilter_go_to_the_smallest_id(spark):
    rows = [("c", k, "https://a.example/team", "Ann Lee", None, "CEO") for k in (9, 7, 3, 8)]
    df = spark.createDataFrame(rows, "company string, id long, url string, name string, email string, title string").coalesce(1)
    assert [r["id"] for r in selection.prefilter(df).collect()] == [3]
