"""Usage-ledger analytics on Spark: DataFrame operators over metered activity records."""
