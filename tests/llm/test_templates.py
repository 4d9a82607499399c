import random

from oracle import same

from fathom.llm import templates


def corpus():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(["the", "of", "a", "blue", "sea", "hill", "over", "9", "ran", "é"]) for _ in range(n))
    docs = []
    for k in range(60):
        lines = [prose(r.choice([3, 9, 30])) for _ in range(r.choice([1, 3, 6]))]
        if k % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), f"Posted by user{k} on 2020-01-{k:02d} at site")
        if k % 4 == 0:
            lines.append(f"Thank you {r.choice(['Ann', 'Bob', 'Cy', 'Di', 'Ed'])} for reading our daily news")
        docs.append((k, "\n".join(lines)))
    docs += [(100 + k, docs[1][1]) for k in range(30)]  # copies: their lines stay
    docs += [(200, None), (201, ""), (202, "\n \n"), (203, "Posted by user1 on 1 at site"), (204, " Posted by user5 on 5 at site "), (203, "Posted by user1 on 1 at site"), (None, docs[0][1]), (205, "word " * 4000)]
    docs += [(300 + k, f"{k} {k}\n{k}. item {k}\n{prose(5)}") for k in range(20)]  # mostly variable: stays
    return docs


def test_against_sql(spark, tmp_path):
    spark.createDataFrame([(*d, 3, "k") for d in corpus()], "doc_id long, text string, place int, key string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), "op4_line_templates")


def test_what_goes(spark):
    docs = spark.createDataFrame([(*d, "x", len(d[1] or "")) for d in corpus()], "doc_id long, text string, leaf string, n_chars int")
    out = templates.without_boilerplate(docs)
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert "Posted by" not in rows[0].text and "Thank you" not in rows[4].text
    assert rows[101].text == corpus()[1][1]
    assert rows[0].n_chars == len(rows[0].text)
    assert 203 not in rows and 201 in rows and 200 in rows and rows[200].text is None


def test_empty_and_given(spark, tmp_path):
    assert templates.deduped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same(spark, "/root/testdata/sf0.001", "op4_line_templates")


def test_blocks_and_hot_copies(spark):
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nrstxz"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    footer = ["All rights are reserved by us", "Contact the office for further help", "Made with care in the city"]
    docs = [(k, "\n".join([prose(60), *footer])) for k in range(40)]  # three fixed lines: the inner ones have one pair of neighbours
    docs += [(100 + k, f"{prose(40)}\nSubscribe to the weekly letter now\n{prose(40)}") for k in range(30)]
    hot = f"{prose(40)}\nSubscribe to the weekly letter now\n{prose(40)}"
    docs += [(200 + k, hot) for k in range(100)]  # copies of one that has the line too
    near = prose(80).split(" ")
    docs += [(400 + k, " ".join(f"edit{'abcdefghijklmnopqrst'[k]}" if i == 3 * k else w for i, w in enumerate(near)) + "\nA closing line of this one page") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text for x in templates.without_boilerplate(df).collect()}
    gone = {*footer, "Subscribe to the weekly letter now"}
    assert got == {d: "\n".join(x for x in t.split("\n") if x not in gone) for d, t in docs}  # the near copies keep their line


def test_what_recurs_across_documents(spark, tmp_path):
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nrstxz"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    banner = ["Welcome to the harbour news", "Read by all the town", "Printed at the old mill", "Sold on every corner"]
    docs = [(k, "\n".join([*banner, prose(60)])) for k in range(40)]
    docs.append((100, "\n".join(x for _ in range(12) for x in (prose(9), "and so we sing the song again"))))  # a refrain of one document
    docs += [(200 + k, f"{prose(50)}\nSubscribe to the weekly letter now") for k in range(30)]
    docs += [(300 + k, f"A page of its own\n{docs[41][1]}") for k in range(100)]  # a hot group of copies of one text
    lines = [prose(20) for _ in range(8)]
    docs += [(500 + k, "\n".join(prose(20) if i == k % 8 else x for i, x in enumerate(lines))) for k in range(40)]  # copies that differ in a line
    docs += [(None, docs[0][1]), (600, banner[1] + "\n" + " ".join(["word"] * 50_000)), (601, None), (602, "")]
    df = spark.createDataFrame([(*d, 7, "x", "y") for d in docs], "doc_id long, text string, N_lines_dropped int, text_a string, fathom_gone string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), "op4_line_templates")
    gone = {*banner, "Subscribe to the weekly letter now"}
    want = sorted(((d, None if t is None else "\n".join(x for x in t.split("\n") if x not in gone)) for d, t in docs), key=str)
    assert sorted(((x.doc_id, x.text) for x in templates.deduped(df).collect()), key=str) == want
    out = templates.without_boilerplate(df)
    assert out.columns == df.columns and {x.N_lines_dropped for x in out.collect()} == {7}
