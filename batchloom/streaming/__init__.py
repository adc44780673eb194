"""Job lifecycle and incremental arrival of pages."""
