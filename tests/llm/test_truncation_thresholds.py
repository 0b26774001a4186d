"""The threshold of a language does not jump at a number of texts."""

from brepflow.llm import truncation as T


def test_one_rule_at_every_size(spark):
    low, high = T.GAP_RANGE
    middles = [low + T.GAP_STEP * (i + 0.5) for i in range(int((high - low) / T.GAP_STEP))]

    def threshold(n):
        """Of a language with n texts and its gap at 9, beside one with its gap at 3."""
        rows = [("en", m, 0 if abs(i - 3) <= 1 else 200) for i, m in enumerate(middles)]
        rows += [("es", m, 0 if abs(i - 9) <= 1 else n // 9) for i, m in enumerate(middles)]
        t = spark.createDataFrame(rows, "lang string, score double, n int").selectExpr("lang", "score", "explode(array_repeat(0, n))")
        return T.thresholds(t)["es"]

    assert threshold(486) == threshold(513) == threshold(5130)
