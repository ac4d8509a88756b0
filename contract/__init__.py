"""The checked queries: each as a Spark job and as plain SQL."""
