"""keyloom: ordered, typed, duplicate-tolerant indexes over Spark DataFrames."""
