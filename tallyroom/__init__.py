"""Operational data work on Spark: card readings, mail campaigns, mail-server
logs and spreadsheet questionnaires, each operator a function over DataFrames."""
