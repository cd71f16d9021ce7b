"""Pages as trees, cards by each strategy, addresses with the nearest name."""

import pytest
from pyspark.sql import functions as F

from leadlens.operators import extraction, page_tree

FILL = "<main><h1>Team</h1>"


def run(spark, f, pages):
    df = spark.createDataFrame([(i, f"https://acme.example/team/{i}", h, "acme.example") for i, h in enumerate(pages)], "page_id long, url string, html string, domain string")
    return f(df)


def found(spark, *pages):
    rows = run(spark, lambda p: extraction.cards(page_tree.trees(p)), pages).collect()
    return {i: {r["name"]: (r["title"], r["kind"].removeprefix("card_")) for r in rows if r["page_id"] == i} for i in range(len(pages))}


def test_tree(spark):
    html = "<div id='A' class='Card big'>x<p>one <b>two</b></p><img alt='p'>tail<script>no</script><ul><li>a<li>b</ul></div></i><p>last"
    tree = run(spark, page_tree.trees, [html, None, "just text"]).orderBy("page_id").collect()
    assert tree[0]["strings"] == ["x", "one", "two", "tail", "a", "b", "last"]
    e = tree[0]["elements"]
    assert [x["tag"] for x in e] == ["div", "p", "b", "img", "script", "ul", "li", "li", "p"]
    assert (e[0]["low"], e[0]["high"], e[0]["last"], e[0]["kids"], e[0]["class"], e[0]["id"]) == (0, 6, 7, 4, "card big", "a")
    assert e[1]["next"] == 3 and e[3]["next"] == 4 and e[0]["next"] == 8 and e[8]["next"] == -1
    assert (e[1]["before_low"], e[1]["before_high"]) == (0, 1) and (e[4]["before_low"], e[4]["before_high"]) == (3, 4)
    assert e[6]["box"] == 0 and e[6]["block"] == 0 and e[5]["peers"] == 1 and e[5]["peer_strings"] == 2
    assert tree[1]["elements"] == [] and tree[2]["strings"] == ["just text"] and tree[2]["owners"] == [-1]


def test_names_and_titles(spark):
    said = {"Jane Doe": (True, False), "BRITTANY BRANDT, CPA": (True, False), "JANE DOE": (False, False), "Ana-Maria O'Neil": (True, False), "VP Sales": (False, True), "Our Team": (False, False), "jane doe": (False, False), "Jane": (False, False), "Chief Executive Officer": (False, True), "Jane Doe 2": (False, False), "": (False, False), "Tax Accountant": (False, False)}
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = {r["s"]: (r["n"], r["t"]) for r in df.select("s", extraction.like_name(F.col("s")).alias("n"), extraction.like_title(F.col("s")).alias("t")).collect()}
    assert got == said


def test_each_strategy(spark):
    pages = [
        "<div><a href='https://linkedin.com/in/a'>Ann Lee</a><p>Chief Executive Officer</p></div><div><a href='https://www.linkedin.com/in/b'><img><p>Bob Ray</p><p>VP Sales</p></a></div><article><h3>Cy Fox</h3><p>Head of Data</p><a href='https://linkedin.com/in/c'></a></article>",
        "<div class='member-card'><h4>Ann Lee</h4><span class='role'>Founder</span></div><div class='bio'><p>Bob Ray</p><p>VP Sales</p></div><nav><div class='person'><h4>Not Here</h4></div></nav>",
        "<ul><li><i>Ann Lee</i><i>Chief Executive Officer</i></li><li><i>Bob Ray</i><i>VP Sales</i></li><li><i>Cy Fox</i><i>Director</i></li></ul>",
        "<p><img alt='Ann Lee - Chief Executive Officer'></p><p><img alt='Bob Ray VP Sales'></p><p><img alt='logo'>Cy Fox</p><figure><i><img></i><i>Di Orr</i></figure><p><img alt='company logo'></p>",
        "<h3>Ann Lee, CPA</h3><p>Chief Financial Officer</p><h3>Our Services</h3><p>VP Sales</p>",
        "<ol><li>Ann Lee</li><li>Bob Ray<b>Director of Sales</b></li></ol>",
    ]
    got = found(spark, *pages)
    assert got[0] == {"Ann Lee": ("Chief Executive Officer", "profile"), "Bob Ray": ("VP Sales", "profile"), "Cy Fox": ("Head of Data", "profile")}
    assert got[1] == {"Ann Lee": ("Founder", "class"), "Bob Ray": ("VP Sales", "class")}
    assert got[2] == {"Ann Lee": ("Chief Executive Officer", "siblings"), "Bob Ray": ("VP Sales", "siblings"), "Cy Fox": ("Director", "siblings")}
    assert got[3] == {"Ann Lee": ("Chief Executive Officer", "portrait"), "Bob Ray": ("VP Sales", "portrait"), "Cy Fox": (None, "portrait"), "Di Orr": (None, "portrait")}
    assert got[4] == {"Ann Lee": ("Chief Financial Officer", "heading")}
    assert got[5] == {"Ann Lee": (None, "item"), "Bob Ray": ("Director of Sales", "item")}


def test_scopes(spark):
    """Three names in sections end the search; fewer go on to the page, and to headings and items only if there are still fewer."""
    people = lambda *names: "".join(f"<div><p>{n}</p><p>VP Sales</p></div>" for n in names)
    three, two = people("Ann Lee", "Bob Ray", "Cy Fox"), people("Ann Lee", "Bob Ray")
    rest = "<div class='x'><div class='card'><h4>Di Orr</h4></div></div><h3>Ed Poe</h3>"
    got = found(spark, f"<section id='team'>{three}</section>{rest}", f"<section id='team'>{two}</section>{rest}", f"<section class='our-people'><h4>Ann Lee</h4><p></p></section><h3>Ed Poe</h3>", f"<div><h2>Meet our leadership</h2></div><div><h2>Meet the team</h2><i>x</i></div>{rest}")
    assert set(got[0]) == {"Ann Lee", "Bob Ray", "Cy Fox"}
    assert set(got[1]) == {"Ann Lee", "Bob Ray", "Di Orr"}
    assert set(got[2]) == {"Ann Lee", "Ed Poe"}
    assert set(got[3]) == {"Di Orr", "Ed Poe"}


def test_section_by_heading_takes_five_siblings_after_it(spark):
    tree = run(spark, page_tree.trees, ["<body><h2>Leadership</h2>" + "<div><p>a</p><p>b</p></div>" * 7 + "<ul><li>a</li></ul></body>"])
    got = tree.select(extraction.sections(F.col("elements"), F.col("strings")).alias("s")).first()["s"]
    assert [r["at"] for r in got] == [2, 5, 8, 11, 14]


def test_addresses(spark):
    pages = [
        "<p><a href='mailto:ann.lee@acme.example?subject=Hi'>Ann Lee</a></p>",
        "<h3>Bob Ray</h3><div><p>Write:</p><a href='mailto:b.r@acme.example'>Mail</a></div>",
        "<div><b>Cy Fox</b><span><a href='mailto:cf%40acme.example'>Mail</a></span></div>",
        "<p data-mail='di [at] acme [dot] example'>Di Orr</p><p>ed.poe@acme.example, ED.POE@acme.example</p><p>info@acme.example</p>",
        "<p>Fay Gil fay at acme dot example</p><p>no@elsewhere.example</p><script>x@acme.example</script>",
    ]
    rows = run(spark, lambda p: extraction.addresses(page_tree.trees(p)), pages).collect()
    got = {(r["page_id"], r["email"]): (r["name"], r["kind"], r["is_role"]) for r in rows}
    assert got == {
        (0, "ann.lee@acme.example"): ("Ann Lee", "mailto_link", False),
        (1, "b.r@acme.example"): ("Bob Ray", "mailto_link", False),
        (2, "cf@acme.example"): ("Cy Fox", "mailto_link", False),
        (3, "di@acme.example"): ("Di Orr", "p", False),
        (3, "ed.poe@acme.example"): ("Ed Poe", "text", False),
        (3, "info@acme.example"): (None, "text", True),
        (4, "fay@acme.example"): (None, "text", False),
        (4, "no@elsewhere.example"): (None, "text", False),
    }
    assert {r["snippet"] for r in rows if r["page_id"] == 4} == {"Fay Gil fay at acme dot example", "no@elsewhere.example"}


def test_candidates_join_cards_and_addresses(spark):
    page = "<section id='team'><div><h3>Ann Lee</h3><p>Chief Executive Officer</p></div><div><h3>Bob Ray</h3><p>VP Sales</p></div></section><p><a href='mailto:ann@acme.example'>Ann Lee</a></p><p>x.y@other.example</p><p>info@acme.example</p>"
    got = {(r["email"], r["name"], r["title"], r["kind"]) for r in run(spark, extraction.candidates, [page, None, ""]).collect()}
    assert got == {("ann@acme.example", "Ann Lee", "Chief Executive Officer", "mailto_link"), (None, "Bob Ray", "VP Sales", "card_class")} or got == {("ann@acme.example", "Ann Lee", "Chief Executive Officer", "mailto_link"), (None, "Bob Ray", "VP Sales", "card_siblings")}


@pytest.mark.parametrize("html, open_", [("<p>Meet the team</p>", True), ("<p>Nothing</p>", False), ("<p class='bio-card'>x</p>", True)])
def test_gate(spark, html, open_):
    df = spark.createDataFrame([("https://acme.example/x", html), ("https://acme.example/case-studies/x", html)], "u string, h string")
    assert [r[0] for r in df.select(extraction.card_gate(F.col("u"), F.col("h"))).collect()] == [open_, False]
