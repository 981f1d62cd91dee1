"""Exact folding: texts of ASCII letters, and ASCII letters of other texts, cost no look-up."""

from pyspark.sql import functions as F

from larder.functions import text

def test_uncommon_characters_are_looked_for_beyond_ascii_alone(spark):
    """some two hundred ranges were tried on every letter, twice."""
    assert text.UNCOMMON.startswith(r"(?=[^\x00-\x7F])")
    rows = spark.createDataFrame([("Straße ÉCLAIR",), ("plain Text",), ("ﬁne ½",), ("İΣ ΑΣ",), (None,), ("",)], "s string")
    folded = rows.select(text.exact_fold(F.col("s")).alias("f"))
    assert [r.f for r in folded.collect()] == ["strasse eclair", "plain text", "fine 1⁄2", "iς ας", "", ""]
    assert folded._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
