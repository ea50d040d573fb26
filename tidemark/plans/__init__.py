"""Event pipelines (``DataFrame -> DataFrame``, batch or streaming) and temporal properties."""
