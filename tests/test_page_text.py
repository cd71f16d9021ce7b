"""Pages as structured text within budgets."""

from leadlens.operators import page_text
from leadlens.operators.page_tree import trees


def texts(spark, pages, **budgets):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return {r["page_id"]: r["text"] for r in page_text.structured(trees(df), **budgets).collect()}


def test_kinds(spark):
    long = "word " * 60
    page = (
        "<html><body><nav><h2>Menu</h2>Home</nav><script type='application/ld+json'> {\"@type\": \"Person\", \"name\": \"Ann Lee\"} </script><script type='application/ld+json'>{\"@type\":\"Product\"}</script><script>track()</script>"
        f"<main><h1>Our team</h1><section><h2>Leaders</h2><p>Ann Lee</p><img alt='Ann Lee, CEO'><img alt='logo of us'><a href='mailto:ann@a.example?subject=x'>Write</a><a href='MAILTO:bob@a.example'>bob@a.example</a></section><p>{long}</p></main>"
        "<div><div><div><h3>Deep</h3><p>far from any room at all</p></div></div></div><footer><h3>Foot</h3>Imprint</footer></body></html>"
    )
    got = texts(spark, [page, None, "<p>Short page</p>", "<main><h1>Same beginning of a section</h1></main><main><h1>Same beginning of a section</h1></main>"])
    assert got[0].split("\n\n") == [
        '[JSON-LD] {"@type": "Person", "name": "Ann Lee"}',
        "[Image alt text]\nAnn Lee, CEO",
        "[Email links]\nWrite <ann@a.example>\nbob@a.example",
        f"[Section]\n## Our team\n## Leaders\nOur team\nLeaders\nAnn Lee\nWrite\nbob@a.example\n{long.strip()}",
        "[Section]\n## Leaders\nLeaders\nAnn Lee\nWrite\nbob@a.example",
    ]
    assert got[1] == "" and got[2] == "[Full page text]\nShort page"
    assert got[3].count("[Section]") == 1


def test_budgets(spark):
    data = "<script type='application/ld+json'>{\"@type\":\"person\"," + "x" * 900 + "}</script>"
    page = f"{data}<p>{'word ' * 900}</p>"
    got = texts(spark, [page], most=700, page_most=300, data_most=200)[0]
    assert got.startswith("[JSON-LD] ") and len(got.split("\n\n")[0]) == 210 and len(got.split("\n\n")[1]) == len("[Full page text]\n") + 300
    assert len(texts(spark, [page], most=400)[0]) == 400
