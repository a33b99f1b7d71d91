"""Panel analytics and forecasting operators as plain functions over Spark DataFrames."""
