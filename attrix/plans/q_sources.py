"""A-group queries: CSV export/import round trips, encodings, JSON records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as A
from ..sources import fixtures
from .catalog import register
from .oracle_views import CHURN, SCORED, with_

_EXPORT_COLS = ["Surname", "Geography", "Segment", "Balance", "Age"]


@register("csv_roundtrip", with_(SCORED) + """
SELECT CustomerId AS id, Surname, Geography, Segment, Balance, Age, risk_score AS score_risque FROM scored""")
def csv_roundtrip(spark, sf):
    s = fixtures.scored(spark, sf)
    path = A.scratch_path(spark, "export") + "/clients.csv"
    A.export_csv(s, path, "CustomerId", _EXPORT_COLS)
    back = A.read_dataset(spark, path)
    return back.select(F.col("id").cast("bigint").alias("id"), "Surname", "Geography", "Segment",
                       F.col("Balance").cast("double").alias("Balance"), F.col("Age").cast("bigint").alias("Age"),
                       F.col("score_risque").cast("double").alias("score_risque"))


# Accented place names derived from the nation names (Latin-1 and Windows-1252 characters).
_PLACE = "translate(Geography, 'AEIOU', 'ÀÉÎÖÛ')"


@register("latin1_roundtrip", with_(CHURN) + f"""
SELECT CustomerId, {_PLACE} AS Place, Segment FROM churn""")
def latin1_roundtrip(spark, sf):
    c = fixtures.churn(spark, sf).select("CustomerId", F.expr(_PLACE).alias("Place"), "Segment")
    path = A.scratch_path(spark, "latin1") + "/clients.csv"
    c.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    back = A.read_dataset(spark, path)     # encoding and separator are detected
    return back.select(F.col("CustomerId").cast("bigint").alias("CustomerId"), "Place", "Segment")


@register("json_records", with_(CHURN) + """
SELECT CustomerId, Surname, Geography, Balance, EstimatedSalary, Exited FROM churn""")
def json_records(spark, sf):
    c = fixtures.churn(spark, sf).select("CustomerId", "Surname", "Geography", "Balance", "EstimatedSalary", "Exited")
    path = A.scratch_path(spark, "json")
    c.write.json(path)
    back = A.read_records(spark, path, c.schema)
    return back
