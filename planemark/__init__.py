"""Local structural orientation from drillhole assays, as Spark jobs."""
