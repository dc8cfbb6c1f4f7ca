"""Reading files, tables and logs into DataFrames."""
