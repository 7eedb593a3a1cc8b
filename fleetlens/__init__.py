"""Fleet placement analytics on Spark: filters, counts, balance checks, plans and reports over inventory tables."""
