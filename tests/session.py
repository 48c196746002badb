"""One local session for tests and checks."""

import os

from tidemark.session import build_session


def spark_session(**conf):
    spark = build_session(
        "tidemark-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.driver.host": "127.0.0.1",
            **conf,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for key in ("TIDEMARK_BLOCK_ROWS",):
        if os.environ.get(key):
            spark.conf.set("spark.tidemark.blockRows", os.environ[key])
    return spark
