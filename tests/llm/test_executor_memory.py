import corpus_pipeline
from quire.llm.store import give_back, table

SF = "/root/testdata/sf0.001"


def collections(spark):
    """Full collections so far; in local mode the executor is this JVM."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_executors_give_back_memory(spark):
    before = collections(spark)
    give_back(spark)
    assert collections(spark) > before


def test_every_stage_begins_with_memory_given_back(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = collections(spark)
        stage(spark, docs, SF)
        assert collections(spark) > before, name
