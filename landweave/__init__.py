"""landweave: landscape connectivity on Spark DataFrames."""
