"""Training-data operators.

Nothing outside this folder imports it: the query engine works without it.
Every operator takes DataFrames and returns DataFrames; nulls, empty texts,
ties and repeated rows have a result stated in each operator's docstring.
"""
