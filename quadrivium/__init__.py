"""Course-content and training-data analytics, expressed as Spark DataFrame functions."""
