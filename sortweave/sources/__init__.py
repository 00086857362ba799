"""Sources and sinks: fixed-width binary files, Parquet record structs, generated data and counter logs."""
