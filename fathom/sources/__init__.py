from fathom.sources.csv import csv_source, PANDAS_NA
from fathom.sources.sinks import csv_sink
from fathom.sources.synthetic import synthetic_alloy, synthetic_alloy_range
from fathom.sources.tables import load_table, read_table

__all__ = ["csv_source", "PANDAS_NA", "csv_sink", "synthetic_alloy", "synthetic_alloy_range",
           "load_table", "read_table"]
