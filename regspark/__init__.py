"""regspark: analytics over regulatory and other structured-text corpora as Spark jobs."""
