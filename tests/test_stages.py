import time

from weftline.plans.stages import Stages, clear


def test_staged_tables_are_dropped_and_cleared(spark):
    stages = Stages(spark)
    one, two = (stages.write(spark.range(n)) for n in (3, 4))
    assert one.count() == 3 and two.count() == 4
    stages.drop(one)
    clear(spark, older_than_hours=1)
    assert two.count() == 4  # too young
    assert clear(spark, older_than_hours=-1) >= 1


def test_staged_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {name for f in blocks.getAllFiles().mkString("\n").split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}

    before = files()
    Stages(spark).write(spark.range(1000).repartition(3, "id"))
    for _ in range(20):  # files are deleted by the cleaner's messages
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
