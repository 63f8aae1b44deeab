"""Queries over tables read as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.registry import query, table
from tallyframe.streaming import restatements as R
from tallyframe.tables import shared_path

_KEYS, _SEQ = ["l_partkey", "l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]


@query("""SELECT l_partkey, l_returnflag, max({'s': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 'v': l_quantity}).v AS l_quantity FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount > 0.02 GROUP BY ALL""")
def q74_streamed_restatements(spark: SparkSession, d: str) -> DataFrame:
    """The last quantity of each part and flag, from the table's files as they arrive: deliveries without discount tell nothing."""
    target, schema = shared_path(spark, "restated"), table(spark, d, "lineitem").schema
    # a pattern, as the table may be one file or a folder of them
    told = R.latest_facts(spark, f"{d}/lineitem.parque[t]", schema, target, f"{target}-progress", _KEYS, "l_quantity", _SEQ, files=4, where=F.col("l_discount") > 0.02)
    told.awaitTermination()
    return R.current(spark, target, schema, _KEYS, "l_quantity", _SEQ)
