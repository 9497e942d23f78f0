"""Claims-triage analytics on Spark: table operators, DataFrame in and DataFrame out."""
