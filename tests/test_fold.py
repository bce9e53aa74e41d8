"""Letters outside Latin-1 are folded."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


@pytest.mark.parametrize(("given", "wanted"), [
    ("Łódź Ęą", ["lodz", "ea"]), ("Őrült Űr", ["orult", "ur"]), ("Şişli İstanbul ığdır", ["sisli", "istanbul", "igdir"]), ("Țară Știință", ["tara", "stiinta"]),
    ("Đường Việt ưỡng", ["duong", "viet", "uong"]), ("Příliš žluťoučký", ["prilis", "zlutoucky"]), ("Þór Œuvre ĳs ǆ ﬃ ｆｕｌｌ ŋ", ["thor", "oeuvre", "ijs", "dz", "ffi", "full", "n"]), ("Москва Ωμέγα 東京", ["москва", "ωμέγα", "東京"]),
])
def test_fold_beyond_latin_1(spark, given, wanted):
    assert spark.range(1).select(T.analyze(F.lit(given)).alias("x")).first()["x"] == wanted
