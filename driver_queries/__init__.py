"""The engine applied to the test tables, and the SQL its results are checked against."""
