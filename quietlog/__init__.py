"""quietlog: find inactive topics and partitions of a partitioned log, on Spark."""
