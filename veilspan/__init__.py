"""veilspan: sensitive-data detection and anonymization on PySpark DataFrames."""
