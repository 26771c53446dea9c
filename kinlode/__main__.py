"""python -m kinlode train|test|package|all --data-dir DIR --work-dir DIR --output-dir DIR"""

import argparse

from pyspark.sql import SparkSession

from kinlode.plans import matching
from kinlode.sources import package


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=("train", "test", "package", "all"))
    for name in ("data", "work", "output"):
        p.add_argument(f"--{name}-dir", required=name != "output", default="output")
    p.add_argument("--rounds", type=int, default=100)
    a = p.parse_args()
    spark = SparkSession.builder.appName("kinlode").getOrCreate()
    settings = matching.Settings(a.work_dir, rounds=a.rounds)
    if a.step in ("train", "all"):
        print(matching.run_train(spark, a.data_dir, settings))
    if a.step in ("test", "all"):
        matching.run_test(spark, a.data_dir, settings, a.output_dir)
    if a.step in ("package", "all"):
        print(package.pack_results(spark, a.output_dir, f"{a.output_dir}/results.zip"))


if __name__ == "__main__":
    main()
