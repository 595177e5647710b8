"""The registered queries: table mapping, Spark plans and the SQL they are checked against."""
