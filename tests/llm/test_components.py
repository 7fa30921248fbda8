"""Components of links: right labels, and few jobs where the links fit a task."""

import random

from pyspark.sql import functions as F

from panelkit.llm import components


def graph():
    """A long chain in mixed order, random links, copies, and a link of a node with itself."""
    rng = random.Random(4)
    chain = rng.sample(range(-300, 300), 200)
    links = list(zip(chain, chain[1:])) + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    return links + links[:20] + [(2**62, 2**62), (-2**62, 5000)]


def least(links):
    label = {x: x for link in links for x in link}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_links_of_one_task_take_few_jobs(spark):
    links = graph()
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("few-links", "components of few links")
    try:
        got = components.components(df)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 6
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(k, None)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == least(links)
    assert components.components(df.where(F.lit(False))).collect() == []


def test_links_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "LINKS_PER_TASK", 60)
    links = graph()
    rows = [tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == least(links)
