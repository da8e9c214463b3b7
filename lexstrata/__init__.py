"""lexstrata: regulation-change analytics and corpus preparation on Spark."""
