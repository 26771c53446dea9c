"""Small text files in the store that Spark's paths name, local or shared."""

from pyspark.sql import SparkSession


def write_text(path: str, text: str) -> None:
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(path: str) -> str:
    return SparkSession.active().read.text(path, wholetext=True).first()["value"]
