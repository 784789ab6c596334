"""Fresh folders for files a query writes and reads back, under the cluster's shared folder."""

import uuid

from pyspark.sql import SparkSession

from ..session import checkpoint_dir


def fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
