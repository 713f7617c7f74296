"""Road-graph analytics on PySpark: graphs, costs and routes as DataFrames."""
