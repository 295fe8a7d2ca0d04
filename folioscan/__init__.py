"""Paper audits and corpus preparation on Spark."""
