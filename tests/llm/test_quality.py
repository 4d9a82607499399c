import random

from oracle import same

from fathom.llm import quality


def odd_documents():
    r = random.Random(8)
    words = ["one", "two", "Été", "a|b", "x", "***", "THE", "AND!!", "|", "é", "»", "$5"]
    docs = [(k, "".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "  ", "\x0b", "\r\n"]) for _ in range(r.choice([1, 7, 8, 9, 30, 200])))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a " * 5000), (104, "w x y z " * 3 + "a b c d e f g h " * 2), (105, " ".join(f"u{k}" for k in range(30)))]
    docs += [(106, "Home | About | News | Contact\n" + " ".join(f"v{k}" for k in range(40))), (107, "READ THIS NOW!! WONDERFUL OFFER!! BUY MORE!!\n" * 3), (105, "same"), (105, "same"), (None, "ok " * 25), (108, "All Rights Reserved.\nCookies: we use cookies\n" + "fine words here. " * 9)]
    return docs


def test_odd_documents(spark, tmp_path):
    spark.createDataFrame([(*d, "x", [1]) for d in odd_documents()], "doc_id long, text string, words string, lines array<int>").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), "op7_line_first")


def test_given_documents(spark):
    same(spark, "/root/testdata/sf0.001", "op7_line_first")


def test_verdicts(spark):
    prose = "It was a fine day and we all went down to the sea to look at the ships that came in from far away."
    docs = [(1, prose), (2, prose + "\nHome | News | Shop | Help"), (3, "a | b | c | d | e | f | g | h | i | j | k | l | m | n | o | p | q | r | s | t | u"), (4, "x*** y$$$ " * 15), (5, "short")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in range(1, 6)] == [True, True, False, False, False]
    assert got[2].clean == prose


def test_native_plan_and_empty(spark):
    df = quality.judged(spark.createDataFrame([], "doc_id long, text string"))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_punctuation_and_menus(spark, tmp_path):
    prose = "It was a fine day and we all went down to the sea to look at the ships that came in from far away."
    quoted = "«Je viens», dit-il, «si tu veux», et «peut-être» encore, mais «pas ce soir», «ni demain» non plus."
    german = "»Komm«, sagte sie, »wenn du magst«, und »vielleicht« auch »morgen«, aber nicht heute, »sonst« nie."
    bad = ["Home About News Contact", "  • Garden chairs", "- one two three", "The council met on Monday and…", "and then they ...", "Page 3", "Startseite Kontakt", "* * *", "Home » Shop » Chairs » Oak"]
    good = [quoted, german, "We went home.", "Yes!", "He said:", "- we took the long way home and were late.", "The news about the harbour is good", "A heading of some words", "1. It begins (here)", "home alone at last"]
    docs = [(k, "\n".join([prose, prose[::-1] + ".", x])) for k, x in enumerate(bad + good)]
    docs += [(100, "\n".join(bad)), (101, "\r" + prose + "\r\n Page 3 \r\n\t- x y\x0b"), (102, "word " * 30_000 + "\n" + "-" * 50_000 + "\n" + "home" * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    for k, x in enumerate(bad + good):
        assert (x in got[k].clean.split("\n")) == (x in good), x
        assert got[k].kept
    assert not got[100].kept and got[101].n_lines_removed == 2
    df.write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), "op7_line_first")
