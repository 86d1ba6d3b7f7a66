"""newsloom: a news analytics engine written as Spark DataFrame jobs."""
