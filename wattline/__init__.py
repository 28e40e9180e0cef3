"""Analytics over cluster and power traces, written as Spark plans."""
