"""Records tables derived from the driver's test tables, and the queries checked on them."""
