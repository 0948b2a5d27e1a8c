"""The grammar on hand-worked clauses, and held-out accuracy on the labelled table."""

import numpy as np

from roadspark.llm.toxicity import Grammar, fit, grammar, insults, reported, toxicity


def test_composition_runs_both_machines():
    both = insults().compose(reported())
    state, said = 0, []
    for symbol in (1, 5, 0, 1):
        state, weights = both.moves[state][symbol]
        said.append(weights)
    assert said == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]
    assert len(grammar().moves[0][0][1]) == 5


def test_clauses_matter():
    made = Grammar({b"moron": 1.0}, np.array([-1.0, 1, 1, 0, 1]))
    plain, aimed = made.score(b"a moron here"), made.score(b"you moron")
    assert made.score(b"not a moron") < plain < aimed
    assert made.score(b"he said a moron") < plain
    assert made.score(b"he said. a moron") > made.score(b"he said a moron")
    assert made.score(b"i will kill you") > made.score(b"i will kill time") == made.score(b"")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 500
    assert (got.predicted == got.toxic).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_edge_cases(spark):
    rows = [(i, f"word{i} filler text") for i in range(40)] + [(100 + i, f"such a moron, number {i}") for i in range(20)]
    odd = [(1000, None), (1001, ""), (None, "such a moron"), (1002, "x " * 100_000 + "number such moron"), (1, "word1 filler text")]
    docs = spark.createDataFrame([(a, b, 0, 0.5) for a, b in rows + odd], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(a, int(a >= 100), 1) for a, _ in rows], "doc_id long, toxic int, quality int")
    got = {(r["doc_id"], r["predicted"]) for r in toxicity(docs, labels).collect()}
    assert {(1000, 0), (1001, 0), (1, 0), (105, 1), (None, 1)} <= got and len(got) == 64
    assert toxicity(docs.limit(0), labels).collect() == []
    assert {r["predicted"] for r in toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    assert fit(docs, labels.limit(0)).lexicon == {}
