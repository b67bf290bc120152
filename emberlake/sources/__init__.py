"""Feed parsers: raw payload rows to normalized records.

A raw row is (url, payload, fetched_at); ``raw_zone`` reads them from the landing
folders. Parsers only use built-in expressions, so a payload is parsed where it is.
"""
