"""A PySpark-native engine for corpora of STEP texts, their captions, scores and logs."""
