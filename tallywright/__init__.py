"""Decision-ledger analytics as Spark DataFrame functions."""
