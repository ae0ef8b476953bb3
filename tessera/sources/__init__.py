"""Readers and writers: tables, HTML pages, workbooks."""
