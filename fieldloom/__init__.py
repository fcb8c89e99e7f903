"""fieldloom: kernel intensity fields and corpus preparation as Spark jobs."""
