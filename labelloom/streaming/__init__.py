"""Nothing to add here: the workloads this library covers are finished tables.

Row-level operators (``labelloom.functions``) are plain column expressions, so
they apply to a streaming DataFrame as they are.
"""
