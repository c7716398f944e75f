from pyspark.sql import SparkSession


def session(cores=8):
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("trustdesk")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
