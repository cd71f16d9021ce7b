"""The registered queries: logical tables, Spark plans, and the SQL each is checked against."""
