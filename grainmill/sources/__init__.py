"""Tables: the catalog, appends, and folders of Parquet."""
