"""Analytics over ranked weekly lists and the text and metadata joined to them, on Spark DataFrames."""
