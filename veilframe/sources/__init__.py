"""Tables, catalogs, rules, and where results are written."""
