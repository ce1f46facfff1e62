"""docproof: document verification as Spark DataFrame operators.

``functions``  column expressions (text, checksums, dates, parsing, rules)
``operators``  DataFrame-to-DataFrame operators (joins, group-bys, windows)
``sources``    readers, sinks and the input tables derived from the test data
``plans``      whole extract / verify / analyse plans built from the above
``streaming``  Structured Streaming intake running the same plans
"""
