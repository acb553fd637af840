"""A Spark-first analytics library: relational, window, time-series, streaming and text work as DataFrame functions."""
