"""fathomite: evidence retrieval, verification and corpus preparation as PySpark plans."""
