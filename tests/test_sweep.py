"""The sweep's votes: those of exploded grid points, without copies of the chosen rules."""

import random

from pyspark.sql import functions as F

from casebase.operators.vote import grid_right, vote_bounded

KS, RNOS = (1, 2, 4), (1, 3)


def _chosen(spark, label):
    draw = random.Random(5)
    rows = []
    for fold in range(3):
        for q in [*range(25), 7, None]:                        # an id that comes twice, and a missing one
            own = draw.choice([0, 1, 2, None])
            for base_rank in range(1, 5):
                base = draw.choice([None, draw.randrange(6), 10**18 + draw.randrange(3)])
                for rule_rank in range(1, draw.randrange(2, 6)):
                    rows.append((fold, q, own, base, base_rank, rule_rank, draw.choice([0, 1, 2, None])))
    df = spark.createDataFrame(rows, "fold int, query_id long, label int, base_id long, base_rank int, rule_rank int, "
                                     "to_label int")
    return df.withColumns({c: F.col(c).cast(label) for c in ("label", "to_label")}).cache()


def _exploded(chosen):
    def points(values, rank):
        return F.explode(F.filter(F.array(*map(F.lit, values)), lambda x: x >= F.col(rank)))

    grid = chosen.withColumn("k", points(KS, "base_rank")).withColumn("rno", points(RNOS, "rule_rank"))
    keys = ["fold", "k", "rno", "query_id", "label"]
    pred = vote_bounded(vote_bounded(grid, [*keys, "base_id"], "to_label", "target"), keys, "target")
    return pred.where("prediction = label").groupBy("fold", "k", "rno").agg(F.count(F.lit(1)).alias("right"))


def _rows(df):
    return sorted(tuple(r) for r in df.select("fold", "k", "rno", "right").collect())


def test_votes_of_the_grid(spark, monkeypatch):
    from casebase.operators import vote
    for label in ("int", "string"):
        chosen = _chosen(spark, label)
        want = _rows(_exploded(chosen))
        assert len(want) == 18
        assert _rows(grid_right(chosen, ["fold"], KS, RNOS, chosen.count())) == want
        monkeypatch.setattr(vote, "GRID_ROWS", 50)             # queries in many parts
        assert _rows(grid_right(chosen, ["fold"], KS, RNOS, chosen.count())) == want


def test_chosen_rules_are_not_copied(spark):
    plan = grid_right(_chosen(spark, "int"), ["fold"], KS, RNOS, 100)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "FlatMapGroupsInPandas" in plan
