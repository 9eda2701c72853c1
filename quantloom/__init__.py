"""quantloom: table operators for estimates, price pools and document knowledge on Spark."""
