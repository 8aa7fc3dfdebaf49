"""A Spark-native engine for financial time series and training-corpus preparation."""
