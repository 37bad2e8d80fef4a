"""Tables from Python data, DataFrames and files."""
