"""What the driver holds at once: the jobs of a query, each of which brings its stages, tasks and plans."""

import random

import brute

from tessera.llm import jaccard


def _jobs(spark, after):
    """For each query that was run after the given one, its number and how many jobs it took."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {x.executionId(): x.jobs().size() for x in (ran.apply(i) for i in range(ran.size())) if x.executionId() > after}


def test_near_duplicates_take_few_jobs_at_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(4)
    texts = []
    for g in range(4):
        base = brute.prose(400 + g, 60).split()
        for _ in range(40):
            w = list(base)
            for _ in range(r.randint(0, 12)):
                w[r.randrange(len(w))] = f"new{r.randint(0, 3)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spark.range(1).count()
    last = max(_jobs(spark, -1))
    want = brute.components(list(enumerate(texts)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df).collect()} == want
    assert max(_jobs(spark, last).values()) <= 9  # 14 when tables that several joins read weren't written
