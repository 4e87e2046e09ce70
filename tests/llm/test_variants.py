"""Rows that share a doc_id but not a text, for the Jaccard join."""

from terrazo.llm import jaccard


def test_each_text_of_an_id_links(spark):
    b = [f"b{k}" for k in range(60)]
    texts = {"A": " ".join(f"a{k}" for k in range(60)), "B": " ".join(b), "near B": " ".join([*b[:-1], "other"]), "far": " ".join(f"c{k}" for k in range(60)), "near A": " ".join([f"a{k}" for k in range(59)] + ["last"])}
    held = [(5, "A"), (5, "B"), (7, "B"), (9, "near B"), (3, "near A"), (20, "far"), (None, "near B"), (None, "far"), (20, None), (30, "")]
    df = spark.createDataFrame([(i, texts.get(t, t)) for i, t in held], "doc_id long, text string")
    got = sorted((str(r[0]), r[1] > 0, r[2]) for r in jaccard.classes(df, 5, 80).collect())
    want = [(5, True, 3), (5, True, 3), (7, True, 3), (9, True, 3), (3, True, 3), (20, True, 20), (None, True, 3), (None, True, 20), (20, False, 20), (30, False, 30)]
    assert got == sorted((str(a), b, c) for a, b, c in want)
