"""tessella: preference-contrast analytics and corpus operators on Spark DataFrames."""
