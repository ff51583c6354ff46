"""tallyloom: retail-observation analytics and corpus preparation as Spark jobs."""
