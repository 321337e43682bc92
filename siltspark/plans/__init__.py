from siltspark.plans import registry, job_queries, report_queries, stored_queries  # noqa: F401, I001  the others add their queries to the first
