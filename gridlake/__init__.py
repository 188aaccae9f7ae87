"""Analytics over spreadsheet cells and tables as plain DataFrame-to-DataFrame operators on PySpark."""
