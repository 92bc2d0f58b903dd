"""What tests share."""


def one(spark, column):
    """Value of a column over no table."""
    return spark.range(1).select(column.alias("x")).first()["x"]
