"""Archive-shaped views over the test tables and the catalogue of queries on them."""
