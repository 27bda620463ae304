"""claimloom: environmental-claim risk analytics and corpus preparation as Spark jobs."""
