"""Lithos: versioned, content-addressed, event-sourced datasets on PySpark."""
