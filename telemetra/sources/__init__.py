"""Reading recordings, calibrations, logs and listings as DataFrames."""
