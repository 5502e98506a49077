"""docweft: document-retrieval analytics and corpus processing as PySpark DataFrame operators."""
