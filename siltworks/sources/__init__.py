"""Readers: files, landed API payloads, HTML tables, workbooks, databases."""
