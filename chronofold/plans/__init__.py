"""Views over the test tables, and the queries that apply each operator to them."""
