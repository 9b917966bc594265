"""Search, reading and conversion of web-page archives on Spark DataFrames."""
