"""Reading and writing mail tables, and turning raw input into mail rows."""
