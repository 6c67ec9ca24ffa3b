"""Sessions for tests, the bench and scripts; a cluster brings its own."""

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None, name: str = "highmark") -> SparkSession:
    """A local session with UTC time, adaptive execution and shuffles as wide as its cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
