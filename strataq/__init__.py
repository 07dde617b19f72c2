"""A PySpark analytics engine for event and state histories."""
