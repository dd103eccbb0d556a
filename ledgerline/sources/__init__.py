"""Sources: file and JSON ingest, grid unpivot, calendar, seeds, and the adapter
that presents the driver's TPC-H-like tables as the conformed star schema."""
