"""Documents, schemas, catalogs and settings as DataFrames."""
