"""Key-value operators over DataFrames."""
