"""quire: document-library analytics as Spark DataFrame jobs.

Layers
------
functions/  Column expressions (text, page state, prices, labels); no actions.
operators/  DataFrame -> DataFrame operators (joins, aggregates, rankings).
sources/    readers, writers and views over the given tables.
streaming/  Structured Streaming jobs with keyed state.
plans/      the registered queries and the SQL they are checked against.
"""
