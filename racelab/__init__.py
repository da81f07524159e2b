"""racelab: grouped-contest analytics on Spark DataFrames."""
