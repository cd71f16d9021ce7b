"""The pipeline: each stage's rows and columns, and its end on the small documents."""

import corpus_pipeline


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data).cache()
        n = out.count()
        assert out.columns == columns and 0 < n <= before, name
        if name == "line_dedup":
            assert n == before
        docs, before = out, n


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    fill = out.groupBy("sequence_id").sum("length").collect()
    assert fill and max(r[1] for r in fill) <= 1024


def test_line_and_near_copy_stages_on_planted_copies(spark):
    text = lambda k: " ".join("w" + "".join(chr(97 + n) for n in (k, i // 26, i % 26)) for i in range(120))
    rows = [(i, text(i), "en", "s", len(text(i))) for i in range(6)] + [(10 + i, text(0), "en", "s", len(text(0))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    lines = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "")
    held = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    assert held[0] == (text(0), len(text(0))) and held[10] == ("", 0)


def edited(base, at):
    words = base.split()
    for k in at:
        words[k] = f"other{k}"
    return " ".join(words)


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copy_stage_reaches_similarity_08(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(300))
    texts = {k: text(k) for k in range(4)}
    for k in range(4):
        texts[10 + k] = edited(texts[k], range(20, 280, 60))  # 5 words
        texts[20 + k] = edited(texts[k], range(10, 290, 18))  # 16 words: further than 0.8
        assert jaccard(texts[k], texts[10 + k]) >= 0.8 > jaccard(texts[k], texts[20 + k])
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 20, 21, 22, 23]


def test_near_copy_stage_on_a_crowd(spark):
    """Copies of one text, each edited elsewhere: more than one bucket's second look takes."""
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, edited(base, range(i, 300, 100))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()] == [0]


def stage_lines(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}


def test_line_stage_drops_identical_lines_with_digits_and_short_ones(spark):
    digits = " ".join(f"w0x{i}" for i in range(120))
    common = f"{digits}\nLicensed under CC BY-NC 4.0.\nAll rights reserved.\n----"
    held = stage_lines(spark, [(i, f"{common}\nown {'abcd'[i]}") for i in range(4)])
    assert held == {0: f"{common}\nown a"} | {i: f"----\nown {'abcd'[i]}" for i in (1, 2, 3)}


def test_line_stage_drops_lines_that_two_documents_have(spark):
    words = lambda c, n: " ".join(f"{c}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))
    rows = [(1, f"{words('p', 51)}\nfirst own"), (2, f"{words('p', 51)}\nsecond own"), (3, f"{words('q', 55)} id 17"), (4, f"{words('q', 55)} id 18\nfourth own"), (5, "Once more\nfifth own"), (6, "Once more\nsixth own")]
    held = stage_lines(spark, rows)
    assert held == dict(rows) | {2: "second own", 4: "fourth own"}


def test_near_copy_stage_on_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(0)), (2, text(0)), (2, text(1)), (3, text(1)), (4, text(2)), (4, text(3)), (4, text(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert sorted(kept) == sorted([(1, text(0)), (2, text(1)), (4, text(2)), (4, text(3))])


def test_stages_on_edge_cases(spark, data, edge, none, edge_rows):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names, and an empty table, in every stage."""
    key = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, data)
        assert stage(spark, none, data).count() == 0, name
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] >= len(edge_rows)
            continue
        got = out.collect()
        assert out.columns == edge.columns, name
        kept = key(got)
        if name in ("toxicity", "decontamination"):  # rows go whole or stay as they are
            assert not [r for r in kept if r not in key(edge.collect())] and (1, None) in kept and (2, "") in kept, name
            assert kept.count((3, edge_rows_text(edge_rows, 3))) in (0, 2), name
        if name == "line_dedup":
            assert len(got) == len(edge_rows) and (1, None) in kept and (2, "") in kept
        if name == "simhash":  # one row of the texts without words, one of the equal texts
            named = [r for r in kept if r[0] is not None]
            assert len([r for r in named if not (r[1] or "").strip()]) == 1
            assert [r[0] for r in named if r[1] == edge_rows_text(edge_rows, 3)] == [3] and (None, None) in kept


def edge_rows_text(rows, doc_id):
    return next(t for d, t in rows if d == doc_id)


def test_near_copy_stage_among_template_pages(spark):
    """Pages of one template, at 0.747 to each other, with pairs at over 0.8: each pair is joined, and no page to another pair's."""
    import random

    rng = random.Random(9)
    frame = [f"t{i}" for i in range(430)]

    def page(own):
        return " ".join(frame[:200] + own + frame[200:])

    rows = []
    for k in range(150):
        own = [f"p{k}x{i}" for i in range(70)]
        rows.append((2 * k, page(own)))
        words = page(own).split()
        for at in rng.sample(range(10, 490), 8):
            words[at] = f"e{k}x{at}"
        rows.append((2 * k + 1, " ".join(words)))
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1]) > 0.7
    near = {d for d in range(0, 300, 2) if jaccard(rows[d][1], rows[d + 1][1]) >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert kept == {d for d, _ in rows} - {d + 1 for d in near} and len(near) > 140
