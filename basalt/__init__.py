"""An analytics engine on Apache Spark: relational operators, functions, views and training-data tools."""
